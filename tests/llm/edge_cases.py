"""A small table of hard cases: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"keep_id": "long", "fingerprint": "string", "score": "double", "text_hash": "string", "row": "int", "h": "int", "_row": "string", "digest": "int"}


def passage(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


def rows() -> list[tuple]:
    shared, other = passage(1), passage(2)
    edited = shared.split()
    edited[-1] = "changed"
    long_text = "\n".join(passage(100 + k, 40) for k in range(300))
    return [
        (1, shared, "en", "a/x", 1),
        (2, shared.upper(), "en", "a/y", None),
        (3, f"{other}\n{shared}\n{passage(3, 20)}", "en", "b/x", 3),
        (4, f"{passage(4, 30)} {shared} {passage(5, 30)}", None, None, 3),
        (5, " ".join(edited), "fr", "c", 0),
        (6, "", "en", "a/x", 0),
        (7, None, "en", "a/x", 0),
        (8, " \t\n ", "fr", "b", 0),
        (9, "Zwei Wörter", "de", "b", 0),
        (10, "日本語 ▁ \U0001f600 é\x00 x", None, "b", 0),
        (11, long_text, "en", "a/x", 1),
        (12, long_text + "\n" + other, "en", "a/z", 1),
        (13, "ab" * 4000, "fr", "d", 1),
        (14, "ab" * 4000, "fr", "d", 1),
        (15, "12345 678 !!", "de", "e", 1),
        (16, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ok PassWord: abc secret=secret=abcdefgh AKIA' + "A1" * 10, "en", "e", 1),
        (17, "x" * 30 + ' token="b44e15e09fd311c3cf3163b66d5a9875b883d8ce" aB3' + "x9" * 12, "en", "f/1", 1),
        (18, "API_KEY : 'b44e15e09fd311c3cf3163b66d5a9875b883d8ce' abc" + "d" * 24, "en", "g/1", 1),
        (18, "the same id, another text, which is long enough to hold fifty bytes and more", "en", "g/1", 1),
        (19, shared, "en", "a/x", 1),
        (19, shared, "en", "a/x", 1),
        (None, shared, "en", "a/x", 1),
        (None, "a text without any id that nobody else has, and of more than fifty bytes", "en", "a/x", 1),
        (-5, "a negative id", "en", "a/x", 1),
    ]


def frame(spark, data=None, partitions: int = 3):
    """The table, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, COLUMNS).repartition(partitions)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CLASHES.items()])


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def letter_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def shingles(words: list[str], size: int = 5) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def weighted_jaccard(a: list[str], b: list[str]) -> float:
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common)
