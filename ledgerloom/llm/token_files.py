"""Token ids in files of fixed-width bit-packed numbers.

A file holds whole documents. All numbers are little-endian:

    header   magic "LLTK", version (u16), bits per id (u16), ids per block (u32),
             number of ids, blocks and documents (u64 each)
    blocks   each block's ids in `bits` bits per id, the lowest bit first, padded to whole bytes
    offsets  the byte position of every block (u64), from the start of the file
    index    doc_id (i64) and first id in the file (u64) of every document; an id of a null is NO_ID

Blocks have a fixed number of ids, so ids a..b are read by their block offsets alone and unpacked
with numpy. Tasks write under a name of their own attempt, and a manifest that Spark commits lists
the files that count, so a lost executor or a repeated task leaves no wrong file in the result.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows, ids_and_texts, shuffle_partitions, texts_of
from ledgerloom.plans.numbering import running_totals
from ledgerloom.plans.shared import Stored, fresh_path

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23
END_ID = 2
NO_ID = -(2**63)
CACHED_WORDS = 900_000
MAGIC = b"LLTK"
HEADER = struct.Struct("<4sHHIQQQ")

#: How the vocabulary writes the end of a token group.
WORD_END = "</w>"

_BATCH_CHARS = 1 << 20
_JOINED_WORDS = 512
_FILE = pa.schema([
    ("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    whole = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return whole[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(whole, axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    whole = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        whole[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        flags = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
        packed = np.packbits(flags, axis=1, bitorder="little")
        whole[:, : packed.shape[1]] = packed
    return whole.view("<u4").ravel()


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        magic, _, self.bits, self.block_ids, self.n_ids, blocks, docs = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        tail = self.file.read_at(8 * blocks + 16 * docs, self.file.size() - 8 * blocks - 16 * docs)
        self.offsets = np.frombuffer(tail, "<u8", blocks).astype(np.int64)
        index = np.frombuffer(tail, "<i8", 2 * docs, 8 * blocks).reshape(docs, 2)
        self.doc_ids, self.firsts = index[:, 0], np.append(index[:, 1], self.n_ids)
        self._block, self._ids = -1, np.empty(0, "<u4")

    def block(self, number: int) -> np.ndarray:
        if number != self._block:
            count = min(self.block_ids, self.n_ids - number * self.block_ids)
            raw = self.file.read_at((count * self.bits + 7) // 8, int(self.offsets[number]))
            self._block, self._ids = number, unpack(raw, count, self.bits)
        return self._ids

    def ids(self, first: int, stop: int) -> Iterator[np.ndarray]:
        """ids first..stop in portions of at most a block."""
        while first < stop:
            number, at = divmod(first, self.block_ids)
            some = self.block(number)[at : at + stop - first]
            yield some
            first += len(some)

    def close(self) -> None:
        self.file.close()


class TokenFileWriter:
    """Writes one file; its packed blocks, the unfinished block and the index are held until it is closed."""

    def __init__(self, path: str, bits: int, block_ids: int = BLOCK_IDS) -> None:
        store, name = fs.FileSystem.from_uri(path)
        self.path, self.bits, self.block_ids = path, bits, block_ids
        self.store, self.name = store, name
        self.blocks: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.n_ids = 0
        self.index: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, self.n_ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            waiting = np.concatenate(self.rest)
            whole = self.held // self.block_ids * self.block_ids
            self.blocks += [pack(waiting[k : k + self.block_ids], self.bits) for k in range(0, whole, self.block_ids)]
            self.rest, self.held = [waiting[whole:]], self.held - whole

    def close(self) -> None:
        if self.held:
            self.blocks.append(pack(np.concatenate(self.rest), self.bits))
        sizes = [len(b) for b in self.blocks]
        offsets = HEADER.size + np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0)
        with self.store.open_output_stream(self.name) as out:
            out.write(HEADER.pack(MAGIC, 1, self.bits, self.block_ids, self.n_ids, len(sizes), len(self.index)))
            for block in self.blocks:
                out.write(block)
            out.write(np.asarray(offsets, "<u8").tobytes())
            out.write(np.array(self.index, "<i8").tobytes())


class WordEncoder:
    """Ids of texts by the tokenizers library, word by word.

    The vocabulary drops white space and never joins characters across it, so a text's ids are those
    of its words one after the other, and the ids of recurring words are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.closing: dict[str, bool] = {}

    def _closes(self, last: str) -> bool:
        """Does a mark after this letter begin a token group? Not if the letter's normal form ends in a combining mark."""
        if last not in self.closing:
            normal = self.tokenizer.normalizer.normalize_str(last + "!")
            self.closing[last] = last.isalpha() and self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)[-1][0] == "!"
        return self.closing[last]

    def _core(self, word: bytes) -> bytes:
        """A word without the ASCII marks at its end, if a letter or an ASCII digit comes before them."""
        core = word.rstrip(b".,;:!?#&*%$@|()[]{}\"-+=/_")
        if core == word or not core or b"<|" in word:
            return word
        return core if core[-1:].isalnum() or core[-1] >= 128 and self._closes(core.decode()[-1]) else word

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words. A tail of ASCII marks is a token group of its own, so a word with one takes
        the ids of its two parts."""
        known = self.known
        tailed, lettered, others = [], [], []
        new: set[bytes] = set()
        for word in words:
            core = self._core(word)
            new.add(core)
            if core != word:
                tail = word[len(core) :]
                tailed.append((word, core, tail))
                new.add(tail)
        for word in new.difference(known):
            (lettered if word.decode().isalpha() else others).append(word)
        for k in range(0, len(lettered), 8 * _JOINED_WORDS):
            others += self._learn_joined(lettered[k : k + 8 * _JOINED_WORDS])
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, ids in zip(part, found, strict=True):
                known[word] = struct.pack(f"<{len(ids.ids)}I", *ids.ids)
        for word, core, tail in tailed:
            known[word] = known[core] + known[tail]

    def _learn_joined(self, words: list[bytes]) -> list[bytes]:
        """Encode words of letters, many as one text; returns those whose ids can't be told apart.

        The last id of a token group, and no other, ends a word. Every word is one group or more (a letter may lower
        to a letter and a mark), so where there are as many groups as words, each word is one.
        """
        portions = [words[k : k + _JOINED_WORDS] for k in range(0, len(words), _JOINED_WORDS)]
        found = self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in portions], add_special_tokens=False)
        unclear: list[bytes] = []
        for portion, encoding in zip(portions, found, strict=True):
            ids = np.array(encoding.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(portion):
                data = ids.tobytes()
                self.known.update(zip(portion, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                unclear += portion
        return unclear

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [_words(t) for t in texts]
        distinct = set().union(*words)
        unknown = distinct.difference(self.known)
        if len(self.known) + len(unknown) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in distinct.difference(unknown)}
        self._learn(unknown)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, some)), "<u4") for some in words]


def _words(text: str) -> list[bytes]:
    """The words of a text, in lower case where that changes no ids.

    The vocabulary is lower case; only its special tokens, which begin with "<|", are told apart by case.
    Texts are composed before they are lowered, and some letters compose in lower case only (U+1E97), so
    where combining marks occur (U+0300 to U+037F begin with the bytes CC and CD), just ASCII words are lowered.
    """
    data = text.encode()
    if "<|" in text:
        return data.split()
    if b"\xcc" in data or b"\xcd" in data:
        return [w.lower() if w.isascii() else w for w in data.split()]
    return data.lower().split()


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(texts_of(batch)):
            ids.append(batch.column(0)[i].as_py())
            texts.append(text or "")
            size += len(texts[-1])
            if size >= _BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(
    docs: DataFrame, vocabulary_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, partitions: int | None = None,
) -> DataFrame:
    """Write the ids of all rows in ascending order of doc_id; returns the stored manifest: part, number, path,
    n_docs, n_ids. A file is closed at the first document with which it has `file_ids` ids.

    Rows are ranged by doc_id and a hash of the text, so an id that many rows share is spread too.
    """
    from tokenizers import Tokenizer

    bits = id_bits(max(Tokenizer.from_file(vocabulary_path).get_vocab_size(with_added_tokens=True), end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary_path)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        end = np.array([end_id], "<u4")
        done: list[tuple] = []
        writer = None

        def close() -> None:
            writer.close()
            done.append((part, len(done), writer.path, len(writer.index), writer.n_ids))

        for ids, texts in _portions(batches):
            for doc_id, found in zip(ids, encoder.encode(texts), strict=True):
                writer = writer or TokenFileWriter(f"{folder}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok", bits, block_ids)
                writer.add(doc_id, np.concatenate([found, end]))
                if writer.n_ids >= file_ids:
                    close()
                    writer = None
        if writer:
            close()
        yield from arrow_rows(done, _FILE)

    ordered = (
        ids_and_texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    )
    return Stored(ordered.mapInArrow(write, "part bigint, number bigint, path string, n_docs bigint, n_ids bigint"), "manifest").frame


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest, which has a row per file, gets the number of ids before each file; then each task opens
    the files of its rows and unpacks them block by block.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from arrow_rows(_documents(row), _DOC)

    placed = running_totals(manifest, ["part", "number"], {"upto": F.col("n_ids")})
    files = placed.select("path", (F.col("upto") - F.col("n_ids")).alias("before")).repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(row: dict) -> Iterator[tuple]:
    file = TokenFile(row["path"])
    for k, doc_id in enumerate(file.doc_ids.tolist()):
        first, stop = int(file.firsts[k]), int(file.firsts[k + 1])
        crc = 0
        for some in file.ids(first, stop):
            crc = zlib.crc32(some.tobytes(), crc)
        yield None if doc_id == NO_ID else doc_id, row["before"] + first, stop - first, crc
    file.close()


def tokens_on_disk(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write all rows as token files into `folder` (by default a new one in the shared folder) and read them back.

    Defined results: a null or empty text has the end id alone; null ids come first; rows that share
    an id follow each other in an order given by their texts; an empty table gives no files and no
    rows; other columns are ignored.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary_path, folder, id_col, text_col))
