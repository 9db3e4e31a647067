"""Multi-job plans: shared storage, exact order statistics, row numbering, training."""
