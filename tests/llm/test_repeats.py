"""Repeated byte strings and repeated lines against brute force."""

import hashlib
import random

import numpy as np
import pytest

from corpus_pipeline import documents
from ledgerloom.llm import suffix_dedup
from ledgerloom.llm.queries import op3_line_dedup
from ledgerloom.llm.suffix_dedup import anchor_runs, remove_repeats, smallest_ids
from ledgerloom.llm.suffix_groups import suffix_array
from ledgerloom.llm.unit_dedup import drop_repeated_units, repeated_units, unit_spans
from tests.llm import edge_cases

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(150):
        symbols = [rng.randint(0, rng.choice([1, 2, 3, 300])) for _ in range(rng.randint(0, 50))]
        assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_a_period():
    symbols = [1, 2] * 500 + [1]
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 4, 300, dtype=np.uint8).tobytes()
    texts = [rng.integers(0, 4, 40, dtype=np.uint8).tobytes() + shared, shared + b"end", b"ab" * 200 + shared]
    per_window = []
    for text in texts:
        starts, stops, hashes = anchor_runs(text)
        assert starts[0] == 0 and stops[-1] == len(text) - 49 and np.array_equal(starts[1:], stops[:-1])
        at = text.index(shared)
        per_window.append(np.repeat(hashes, stops - starts)[at : at + len(shared) - 49])
    assert np.array_equal(per_window[0], per_window[1]) and np.array_equal(per_window[0], per_window[2])


def test_smallest_ids_by_hand():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 40))).encode() for _ in range(40)]
    low = np.array([rng.randint(1, 99) for _ in texts])
    owner, offset, smallest = smallest_ids(texts, low, 6)
    best = {}
    for text, i in zip(texts, low, strict=True):
        for k in range(len(text) - 5):
            best[text[k : k + 6]] = min(best.get(text[k : k + 6], 999), i)
    assert len(owner) == sum(max(0, len(t) - 5) for t in texts)
    assert all(best[texts[o][k : k + 6]] == s for o, k, s in zip(owner, offset, smallest, strict=True))


def removed_by_hand(rows, length=50):
    first = {}
    key = lambda i: 2**63 - 1 if i is None else i
    for doc_id, text in rows:
        for k in range(len(text) - length + 1):
            window = text[k : k + length]
            first[window] = min(first.get(window, key(doc_id)), key(doc_id))
    result = []
    for doc_id, text in rows:
        lost = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            if first[text[k : k + length]] < key(doc_id):
                lost[k : k + length] = True
        spans = int((np.diff(lost.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~lost])
        result.append((doc_id, len(text), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return result


def sortable(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("hot_segments", [1, 10_000])
def test_repeats_edge_cases(spark, hot_segments):
    docs = edge_cases.frame(spark)
    found = remove_repeats(docs, owners=5, hot_segments=hot_segments, bucket_bytes=4096, with_text=True).collect()
    rows = [(r[0], (r[1] or "").encode()) for r in edge_cases.rows()]
    expected = removed_by_hand(rows)
    assert sortable([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]) == sortable(expected)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found if r.kept is not None)
    assert all(sum(s.stop - s.begin for s in r.spans) == r.n_removed for r in found if r.spans is not None)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_whole_table(spark):
    docs = documents(spark, SF_DIR)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    found = remove_repeats(docs).collect()
    assert sortable([tuple(r) for r in found]) == sortable(removed_by_hand(rows))


def test_equal_windows_are_combined_before_the_shuffle(spark, capsys):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(70))
    texts = [("".join(rng.choice("ghi") for _ in range(40)) + shared + "".join(rng.choice("jkl") for _ in range(40))).encode() for _ in range(60)]
    rows = [(1, k, k + 1, k + 1 + k % 3, bytearray(t)) for k, t in enumerate(texts)]
    segments = spark.createDataFrame(rows + rows[:5], "anchor long, content long, low long, high long, segment binary")
    best = {}
    for _, _, low, _, t in rows:
        for k in range(len(t) - 49):
            best[bytes(t[k : k + 50])] = min(best.get(bytes(t[k : k + 50]), low), low)
    expected = {(c, k): best[bytes(t[k : k + 50])] for _, c, _, high, t in rows for k in range(len(t) - 49) if best[bytes(t[k : k + 50])] < high}
    found = suffix_dedup._single_windows(segments, 50)
    runs = found.collect()
    assert {(r.content, k): r.smallest for r in runs for k in range(r.begin, r.stop)} == expected
    assert sum(r.stop - r.begin for r in runs) == len(expected)
    found.explain("simple")
    assert "partial_min(low" in capsys.readouterr().out


def test_repeats_reach_the_windows_of_hot_anchors(spark):
    docs = documents(spark, SF_DIR)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert sortable([tuple(r) for r in remove_repeats(docs, hot_segments=3).collect()]) == sortable(removed_by_hand(rows))


@pytest.mark.parametrize("width", [20, 35, 49])
def test_runs_of_many_texts_are_those_of_each(width):
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 49, 50, 0, 51, 400, 7, 0, 1200, 50, 3)]
    owner, first, last, hashes = suffix_dedup.runs_of_texts(texts, 50, width)
    for k, text in enumerate(texts):
        assert all(np.array_equal(a, b[owner == k]) for a, b in zip(anchor_runs(text, 50, width), (first, last, hashes), strict=True))
    assert len(suffix_dedup.runs_of_texts([b"", b"short"], 50, width)[0]) == 0


def test_content_hashes_tell_parts_apart():
    rng = random.Random(7)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([8, 9, 15, 16, 17, 50, 80]))) for _ in range(3000)]
    parts += [b"\0" * n for n in range(8, 40)] + parts[:50] + [p[:-1] + bytes([p[-1] ^ 128]) for p in parts[:50]]
    sizes = np.array([len(p) for p in parts])
    found = suffix_dedup.content_hashes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert len(set(zip(found.tolist(), parts, strict=True))) == len(set(parts)) == len(set(found.tolist()))


def test_a_hot_anchor_is_cut_at_wider_grams_and_not_into_windows(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, passage = words(20), words(70)
    texts = [words(60) + common + words(60) + (passage if k % 9 == 0 else "") for k in range(120)]
    texts += [t[20:110] + words(30) for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    split = []
    single = suffix_dedup._single_windows

    def counted(segments, length):
        split.append(segments.count())
        return single(segments, length)

    monkeypatch.setattr(suffix_dedup, "_single_windows", counted)
    found = remove_repeats(docs, hot_segments=20).collect()
    assert sortable([tuple(r) for r in found]) == sortable(removed_by_hand([(k, t.encode()) for k, t in enumerate(texts, 1)]))
    assert split == []


def test_length_must_exceed_an_anchor(spark):
    with pytest.raises(ValueError):
        remove_repeats(edge_cases.frame(spark), length=20)


def lines_by_hand(rows, unit, min_words):
    seen, result = set(), {}
    for doc_id, text in rows:
        lost = []
        for begin, stop in unit_spans(text, unit):
            words = text[begin:stop].encode().lower().split()
            if len(words) >= min_words:
                normal = b" ".join(words)
                if normal in seen:
                    lost.append((begin, stop))
                seen.add(normal)
        result[doc_id] = lost
    return result


@pytest.mark.parametrize("unit", ["line", "paragraph"])
@pytest.mark.parametrize("min_words", [1, 5])
def test_lines(spark, unit, min_words):
    data = [(i, t, "en", "s", 0) for i, t in [
        (1, "one two three four five\nx\none  TWO three four five\n\nlast line of this document here"),
        (2, "  One two three four five \n\nx\nlast line of this document here"), (3, None), (4, ""), (5, "\n\n\n"),
        (6, "last line of this document here"), (9, "short line\nshort line"), (10, "é two three four five\nÉ two three four five"),
    ]]
    docs = edge_cases.frame(spark, data)
    expected = lines_by_hand([(i, t or "") for i, t, *_ in data], unit, min_words)
    found = {r.doc_id: r for r in repeated_units(docs, unit=unit, min_words=min_words).collect()}
    assert {i: [(s.begin, s.stop) for s in r.spans] for i, r in found.items()} == expected
    assert all(r.n_removed == len(r.spans) and r.removed_chars == sum(s.stop - s.begin for s in r.spans) for r in found.values())
    texts = {i: t or "" for i, t, *_ in data}
    for r in drop_repeated_units(docs, unit=unit, min_words=min_words).collect():
        assert r.text == "".join(texts[r.doc_id][p.begin : p.stop] for p in r.kept)


def test_lines_edge_cases(spark):
    docs = edge_cases.frame(spark)
    found = repeated_units(docs).collect()
    assert len(found) == len(edge_cases.rows())
    twins = [r.n_removed for r in found if r.doc_id == 19]
    assert len(twins) == 2 and len(set(twins)) == 1
    assert sum(r.n_removed for r in found if r.doc_id == 12) == 301
    assert repeated_units(docs.limit(0)).count() == 0


def test_the_line_query_takes_short_lines_of_every_script(spark, tmp_path):
    texts = {
        1: "all rights reserved.\n\n我们都是人\nonly here", 2: "All  rights reserved.\n \n我们都是人", 3: "x\n\nสวัสดี\nx",
        4: "สวัสดี",
    }
    edge_cases.frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.spans for i, r in found.items()} == {1: "", 2: "0:21,24:29", 3: "10:11", 4: "0:6"}
    assert {i: r.n_removed for i, r in found.items()} == {1: 0, 2: 2, 3: 1, 4: 1}
