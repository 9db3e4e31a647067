"""Readers and writers of applicant tables, requests and mappings."""
