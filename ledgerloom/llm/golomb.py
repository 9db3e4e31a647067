"""Golomb-Rice coding of sorted fingerprints, and the exchange built on it.

Every block of rows sends one coded list of distinct fingerprints to each owner, which is a range
of fingerprints. The owner answers each list with a bitmap of those that other blocks sent as well.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

FINGERPRINT_BITS = 48


def owner_low(owner: int, owners: int) -> int:
    """The smallest fingerprint of an owner."""
    return -(-(owner << FINGERPRINT_BITS) // owners)


def owner_lists(distinct: np.ndarray, owners: int) -> list[tuple[int, int, int, bytes]]:
    """(owner, length, remainder bits, coded list) for sorted distinct fingerprints."""
    lows = np.array([owner_low(o, owners) for o in range(owners + 1)], np.int64)
    cuts = np.searchsorted(distinct, lows)
    lists = []
    for owner in np.flatnonzero(np.diff(cuts)).tolist():
        part = distinct[cuts[owner] : cuts[owner + 1]]
        bits = rice_bits(int(lows[owner + 1] - lows[owner]), len(part))
        lists.append((owner, len(part), bits, encode(part, int(lows[owner]), bits)))
    return lists


def answer_lists(owners: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For all lists of one owner: a bitmap per list of the fingerprints that are in several lists."""

    def answer(lists: pd.DataFrame) -> pd.DataFrame:
        low = owner_low(int(lists["owner"].iloc[0]), owners)
        decoded = [decode(p, n, low, b) for p, n, b in zip(lists["payload"], lists["n"], lists["bits"], strict=True)]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[counts > 1]
        return pd.DataFrame({
            "block": lists["block"], "owner": lists["owner"],
            "bitmap": [np.packbits(np.isin(d, shared, assume_unique=True)).tobytes() for d in decoded],
        })

    return answer


def rice_bits(span: int, count: int) -> int:
    """Remainder bits that suit `count` values spread over `span`."""
    return max(0, (max(span, 1) // max(count, 1)).bit_length() - 1)


def encode(values: np.ndarray, low: int, bits: int) -> bytes:
    """Sorted distinct values, all at least `low`: unary quotients first, then fixed-width remainders."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(low))
    ends = np.cumsum((gaps >> bits) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(bits)) & 1
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def decode(payload: bytes, count: int, low: int, bits: int) -> np.ndarray:
    tail = (count * bits + 7) // 8
    raw = np.frombuffer(payload, np.uint8)
    unary, rest = raw[: len(raw) - tail], raw[len(raw) - tail :]
    ends = np.flatnonzero(np.unpackbits(unary))[:count]
    high = np.diff(ends, prepend=-1) - 1
    flags = np.unpackbits(rest)[: count * bits].reshape(count, bits).astype(np.int64)
    gaps = (high.astype(np.int64) << bits) + (flags << np.arange(bits)).sum(axis=1)
    return np.cumsum(gaps) + low
