"""Pieces and token files: brute force, the libraries themselves, exact round trips."""

import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import documents
from ledgerloom.llm import pieces, token_files
from ledgerloom.llm.queries import PIECE_MODEL, WORD_VOCABULARY
from tests.llm import edge_cases

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(pieces.read_model(PIECE_MODEL))


def best_by_hand(vocabulary, text):
    """Plain Viterbi over the whole text; of equal sums the longer last piece wins."""
    marked = f" {text}".replace(" ", pieces.SPACE)
    best, back = [0.0], [None]
    for end in range(1, len(marked) + 1):
        top, step = -1e300, None
        for start in range(max(0, end - vocabulary.longest), end):
            known = vocabulary.scores.get(marked[start:end])
            if known and best[start] + known[0] > top:
                top, step = best[start] + known[0], (start, known[1])
        if marked[end - 1] not in vocabulary.scores and best[end - 1] + vocabulary.unknown_score > top:
            top, step = best[end - 1] + vocabulary.unknown_score, (end - 1, vocabulary.byte_fallback(marked[end - 1]))
        best.append(top)
        back.append(step)
    ids, end = [], len(marked)
    while end:
        end, some = back[end]
        ids = some + ids
    return ids


def samples():
    rng = random.Random(7)
    return ["a", "  two  spaces\n\tand more ", "日本語のテキスト\U0001f600 é", "x" * 500, "abc" * 300, "\x00\r\n"] + [
        "".join(rng.choice("ab é\n日the,.") for _ in range(rng.randint(1, 300))) for _ in range(60)
    ]


def test_encoding_is_the_best_segmentation(codec):
    for text in samples():
        assert codec.encode(text).tolist() == best_by_hand(codec.vocabulary, text)


def new_words(count, seed):
    rng = random.Random(seed)
    letters = "aeinorstaeinorstdlu.ÅéЖ日\U0001f600\x00" + pieces.SPACE
    return ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 20, 63, 64, 65, 70]))) for _ in range(count)]


def test_parts_side_by_side_are_those_of_the_stream(codec, monkeypatch):
    monkeypatch.setattr(pieces, "SEARCH_CHARS", 100)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 1000)
    parts = new_words(600, 3)
    for part, ids in zip(parts, codec.side_by_side.ids_of(parts), strict=True):
        stream = pieces.ViterbiStream(codec.vocabulary)
        assert np.frombuffer(ids, "<u4").tolist() == stream.feed(part) + stream.finish()
    texts = ["", *(f"{a} {b}\n{c}" for a, b, c in zip(parts, parts[1:], parts[2:])), ""]
    encoded = list(pieces.PieceCodec(pieces.read_model(PIECE_MODEL)).encode_all(iter(texts)))
    assert [codec.encode(t).tolist() for t in texts] == [x.tolist() for x in encoded]
    assert [codec.decode(x) for x in encoded] == texts


def test_remembered_parts_stay_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 50)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 200)
    small, texts = pieces.PieceCodec(pieces.read_model(PIECE_MODEL)), new_words(500, 4)
    assert [small.decode(x) for x in small.encode_all(texts)] == texts
    assert len(small.known) < 50 + 200 and len(small.earlier) < 50 + 200


def test_new_words_take_less_time_than_by_the_stream(codec):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorstdlucmp") for _ in range(10)) for _ in range(20_000)]

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    def streamed():
        stream = pieces.ViterbiStream(codec.vocabulary)
        for word in words:
            stream.feed(f"{pieces.SPACE}{word}") + stream.finish()

    fresh = pieces.PieceCodec(pieces.read_model(PIECE_MODEL))
    assert seconds(lambda: list(fresh.encode_all([" ".join(words)]))) < 0.7 * seconds(streamed)


def test_stream_in_any_portions(codec):
    rng = random.Random(1)
    for text in samples():
        marked = f" {text}".replace(" ", pieces.SPACE)
        stream, found, at = pieces.ViterbiStream(codec.vocabulary), [], 0
        while at < len(marked):
            size = rng.randint(1, 150)
            found += stream.feed(marked[at : at + size])
            at += size
        assert found + stream.finish() == codec.encode(text).tolist()


def test_stream_keeps_a_bounded_window(codec):
    stream, longest_held = pieces.ViterbiStream(codec.vocabulary), 0
    rng = random.Random(2)
    for _ in range(300):
        stream.feed("".join(rng.choice("thereisnosp") for _ in range(50)))
        longest_held = max(longest_held, len(stream.text))
    assert longest_held < 20 * codec.vocabulary.longest


def test_round_trip_and_library_decoder(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in samples() + ["", "a ▁ b", "▁", " ", "\n"]:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        if pieces.SPACE not in text and text.strip():
            assert library.decode([int(i) for i in ids]) == text


def test_pieces_edge_cases(spark):
    docs = edge_cases.frame(spark)
    found = pieces.round_trips(docs, PIECE_MODEL, with_ids=True).collect()
    assert len(found) == len(edge_cases.rows()) and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (6, 7)} == {0}
    texts = pieces.decode_ids(pieces.encode_texts(docs, PIECE_MODEL), PIECE_MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted((str(r[0]), r[1] or "") for r in edge_cases.rows())
    assert pieces.round_trips(docs.limit(0), PIECE_MODEL).count() == 0


def test_pieces_whole_table(spark, codec):
    docs = documents(spark, SF_DIR)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = pieces.round_trips(docs, PIECE_MODEL).collect()
    assert len(found) == len(texts) and all(r.round_trip for r in found)
    for r in found[:40]:
        ids = best_by_hand(codec.vocabulary, texts[r.doc_id]) if texts[r.doc_id] else []
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    assert np.array_equal(token_files.unpack(packed, 1001, bits), ids)


def test_id_bits():
    assert [token_files.id_bits(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("bits", [13, 16])
def test_file_random_access(tmp_path, bits):
    ids = np.random.default_rng(1).integers(0, 2**bits, 5000, dtype=np.uint32)
    writer = token_files.TokenFileWriter(str(tmp_path / "a.tok"), bits, block_ids=64)
    cuts = [0, 3, 3, 700, 701, 5000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        writer.add(None if k == 2 else k, ids[a:b])
    writer.close()
    file = token_files.TokenFile(str(tmp_path / "a.tok"))
    assert file.firsts.tolist() == cuts and file.doc_ids.tolist() == [0, 1, token_files.NO_ID, 3, 4]
    for a, b in [(0, 5000), (63, 65), (4990, 5000), (10, 10), (64, 128)]:
        assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *file.ids(a, b)]), ids[a:b])


def tokens_by_hand(rows):
    """Whole texts through the library, in the order of ids; of one id by text hash."""
    library = Tokenizer.from_file(WORD_VOCABULARY)
    result, start = [], 0
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        result.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return result


@pytest.mark.parametrize("file_ids", [50, 1 << 23])
def test_token_files_edge_cases(spark, tmp_path, file_ids):
    docs = edge_cases.frame(spark)
    manifest = token_files.write_token_files(docs, WORD_VOCABULARY, f"file://{tmp_path}/tok", file_ids=file_ids, partitions=4, block_ids=32)
    found = token_files.read_token_files(manifest).collect()
    order = docs.select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"), "text").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == tokens_by_hand([(r.doc_id, r.text) for r in order])
    assert token_files.tokens_on_disk(docs.limit(0), WORD_VOCABULARY).count() == 0


def test_token_files_whole_table(spark):
    docs = documents(spark, SF_DIR)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    found = token_files.tokens_on_disk(docs, WORD_VOCABULARY).collect()
    assert sorted(map(tuple, found)) == tokens_by_hand(rows)


def test_words_apart_are_words_together():
    library, encoder = Tokenizer.from_file(WORD_VOCABULARY), token_files.WordEncoder(WORD_VOCABULARY)
    texts = [t for t in samples()] + ["don't <|endoftext|> x<|startoftext|>y", "a\x1cb\x85c d e　f", "é ́a", "ÀÉ ǅ İ", "<|EndOfText|> <|ENDOFTEXT|>", "IT'S x's. É.. é,, 7!? a'!! (b) 'll.", "E\u0301. K\u0301 \u212a\u2026."]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("word", [
    "\u092a\u0939\u093e\u095c,", "B\u0130LD\u0130R\u0130!", "\ufb2a,", "\u05d0\ufb4b.", "T\u0308a", "H\u0331.", "W\u030a J\u030c,", "T\u05ae\u0344",
])
def test_letters_that_end_in_a_combining_mark(word):
    library, encoder = Tokenizer.from_file(WORD_VOCABULARY), token_files.WordEncoder(WORD_VOCABULARY)
    for text in (word, f"Plain WORDS, {word} x"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_marks_after_every_letter():
    library, encoder = Tokenizer.from_file(WORD_VOCABULARY), token_files.WordEncoder(WORD_VOCABULARY)
    texts = ["a" + chr(c) + ",!" for c in range(128, 0x30000) if chr(c).isalpha() and not 0x4E01 <= c < 0xABFF and c < 0x20000]
    whole = library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(encoder.encode(texts), whole, strict=True))


def test_joined_words_are_words_alone():
    """Also where a letter becomes two groups (U+0130), scripts compose, words repeat, or the memory of words is full."""
    random = np.random.default_rng(4)
    library = Tokenizer.from_file(WORD_VOCABULARY)
    letters = list("aBzéÉİıßςΣñ가가中あªʰǅﬁ'!.1²٣")
    texts = [" ".join("".join(random.choice(letters, random.integers(1, 9))) for _ in range(random.integers(0, 40))) for _ in range(2000)]
    whole = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = token_files.WordEncoder(WORD_VOCABULARY)
    assert [ids.tolist() for ids in encoder.encode(texts)] == whole
    for start in range(0, 2000, 100):
        encoder.known = dict(list(encoder.known.items())[: token_files.CACHED_WORDS])
        assert [ids.tolist() for ids in encoder.encode(texts[start : start + 100])] == whole[start : start + 100]
    assert encoder._learn_joined(["plain".encode(), "İx".encode()]) != []


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    encoder = token_files.WordEncoder(WORD_VOCABULARY)
    library = Tokenizer.from_file(WORD_VOCABULARY)
    for text in ["a b c d", "d e f.", "g h i j k l m", "a b"]:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 5 + 4
