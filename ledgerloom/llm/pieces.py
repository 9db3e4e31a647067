"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The encoder takes the pieces and scores of a SentencePiece model and finds the segmentation with
the highest sum of scores. (For a model trained by merges this is the best segmentation under its
scores, which may differ from the order of its merges; decoding restores the text either way.)

The search reads characters one after the other. A piece has a bounded length, so only the last
`longest` positions can still be extended. Whenever the backpointer paths of all of them run through
one boundary, the ids before it are final: they are committed and forgotten.

Parts of a text that are shorter than the window commit nothing before their end, so the parts not met before of many
texts are searched side by side, a character of all of them at a time; longer parts go through the stream.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows, ids_and_texts, texts_of

SPACE = "▁"
#: A character without a piece of its own costs this much beyond the lowest score.
UNKNOWN_COST = 10.0
CACHED_WORDS = 100_000
MAX_MODEL_BYTES = 64 << 20
#: Characters of texts that are cut into parts at once, and of new parts that are searched side by side.
GROUP_CHARS = 1 << 18
SEARCH_CHARS = 1 << 15
#: Ids held before they are passed on.
HELD_IDS = 1 << 17

_NEVER = -1e8  # scores below mark pieces that a model keeps for its own use


class PieceVocabulary:
    """The ordinary pieces of a model with their scores, and its byte pieces."""

    def __init__(self, model: bytes) -> None:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.scores: dict[str, tuple[float, list[int]]] = {}
        self.byte_ids: dict[int, int] = {}
        self.table: list[bytes] = []
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                self.table.append(b"")
            else:
                self.scores[piece] = (processor.get_score(i), [i])
                self.table.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so it cannot hold every text")
        usable = [s for s, _ in self.scores.values() if s > _NEVER]
        self.unknown_score = min(usable) - UNKNOWN_COST
        self.longest = max(map(len, self.scores))
        sizes: dict[str, set[int]] = {}
        for piece in self.scores:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], set()).add(len(piece))
        #: The sizes of the pieces that end in three given characters, the longest first.
        self.sizes_by_end = {end: tuple(sorted(some, reverse=True)) for end, some in sizes.items()}
        #: No piece goes on past these places, so all paths meet there: before a space that
        #: follows another character, and around a line break.
        self.parts = re.compile(r"\n| +[^ \n]*|[^ \n]+") if not any(
            "\n" in p or SPACE in p.lstrip(SPACE) for p in self.scores
        ) else re.compile(r"(?s).+")

    def byte_fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


class ViterbiStream:
    """Best segmentation of a text that arrives in any portions. Of equal sums the longer last piece wins."""

    def __init__(self, vocabulary: PieceVocabulary) -> None:
        self.vocabulary = vocabulary
        self.text = ""  # what follows the last committed boundary
        self.best = [0.0]
        self.back: list[tuple[int, list[int]]] = [(0, [])]  # (start of the last piece, its ids)

    def feed(self, portion: str) -> list[int]:
        """Take more characters; returns the ids that became final."""
        step = 4 * self.vocabulary.longest
        final: list[int] = []
        for first in range(0, len(portion), step):
            self._extend(portion[first : first + step])
            if len(self.text) >= step:
                final += self._commit(self._meeting_point())
        return final

    def finish(self) -> list[int]:
        """The ids of the rest; the stream is then empty."""
        return self._commit(len(self.text))

    def _extend(self, portion: str) -> None:
        vocabulary, best, back = self.vocabulary, self.best, self.back
        find, sizes_by_end, nothing = vocabulary.scores.get, vocabulary.sizes_by_end, ()
        end = len(self.text)
        self.text = text = self.text + portion
        for char in portion:
            end += 1
            top, step = -1e300, None
            if end > 2:
                for size in sizes_by_end.get(text[end - 3 : end], nothing):
                    if size <= end:
                        known = find(text[end - size : end])
                        if known is not None and best[end - size] + known[0] > top:
                            top, step = best[end - size] + known[0], (end - size, known[1])
            if end > 1:
                known = find(text[end - 2 : end])
                if known is not None and best[end - 2] + known[0] > top:
                    top, step = best[end - 2] + known[0], (end - 2, known[1])
            known = find(char)
            score = best[end - 1] + (vocabulary.unknown_score if known is None else known[0])
            if score > top:
                top, step = score, (end - 1, vocabulary.byte_fallback(char) if known is None else known[1])
            best.append(top)
            back.append(step)

    def _meeting_point(self) -> int:
        """The last boundary that the paths of all positions still open have in common."""
        end = len(self.text)
        open_ends = set(range(max(0, end - self.vocabulary.longest + 1), end + 1))
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(self.back[last][0])
        return open_ends.pop()

    def _commit(self, boundary: int) -> list[int]:
        pieces, at = [], boundary
        while at > 0:
            at, ids = self.back[at]
            pieces.append(ids)
        if boundary == len(self.text):
            self.text, self.best, self.back = "", [0.0], [(0, [])]
        elif boundary:
            base = self.best[boundary]
            self.text = self.text[boundary:]
            self.best = [b - base for b in self.best[boundary:]]
            self.back = [(0, [])] + [(start - boundary, ids) for start, ids in self.back[boundary + 1 :]]
        return [i for ids in reversed(pieces) for i in ids]


class PieceTree:
    """The pieces as a tree of characters, walked from many places at once."""

    def __init__(self, pieces: Sequence[str]) -> None:
        letters = sorted(set("".join(pieces)))
        #: A number for each character; 0 is one that no piece has.
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        numbers, self.width = {c: i for i, c in enumerate(letters, 1)}, len(letters) + 1
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            at = 0
            for char in piece:
                at = edges.setdefault(at * self.width + numbers[char], len(edges) + 1)
            ends[at] = k
        #: The piece that ends at a node, or -1.
        self.piece = np.full(len(edges) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        # Edges are hashed into one table; those that lose their slot to another go into a smaller one, and so on.
        keys, targets = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys):
            bits = (4 * len(keys)).bit_length()
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.tables) + 1)) % (1 << 64))
            slots = (keys.view(np.uint64) * factor) >> np.uint64(64 - bits)
            held, leads = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            held[slots] = keys
            stay = held[slots] == keys
            leads[slots[stay]] = targets[stay]
            self.tables.append((factor, np.uint64(64 - bits), held, leads))
            keys, targets = keys[~stay], targets[~stay]

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node behind each edge, or -1."""
        keys = nodes.astype(np.int64) * self.width + codes
        out, rest = np.full(len(keys), -1, np.int32), None
        for factor, shift, held, leads in self.tables:
            slots = (keys.view(np.uint64) * factor) >> shift
            found = held[slots]
            hit = found == keys
            if rest is None:
                out[hit] = leads[slots[hit]]
                rest = np.flatnonzero(~hit & (found >= 0))
                keys = keys[rest]
            else:
                out[rest[hit]] = leads[slots[hit]]
                left = ~hit & (found >= 0)
                rest, keys = rest[left], keys[left]
            if not len(rest):
                break
        return out


class SideBySide:
    """The Viterbi search over many short parts at once, with the sums and ties of `ViterbiStream`."""

    def __init__(self, vocabulary: PieceVocabulary) -> None:
        self.vocabulary = vocabulary
        self.tree = PieceTree(list(vocabulary.scores))
        self.scores = np.array([score for score, _ in vocabulary.scores.values()])
        self.ids = np.array([ids[0] for _, ids in vocabulary.scores.values()], "<u4")

    def ids_of(self, parts: Sequence[str]) -> Iterator[bytes]:
        """The ids of every part, as little-endian 32-bit numbers."""
        first, size = 0, 0
        for last, part in enumerate(parts, 1):
            size += len(part)
            if size >= SEARCH_CHARS or last == len(parts):
                yield from self._search(parts[first:last])
                first, size = last, 0

    def _search(self, parts: Sequence[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join([p + "\n" for p in parts]).encode("utf-32-le"), "<u4")
        stops = np.cumsum(lengths + 1) - 1  # the place behind each part
        begins = stops - lengths
        place = (np.arange(len(points)) - np.repeat(begins, lengths + 1)).astype(np.int32)
        codes = self.tree.codes[points]
        codes[stops] = 0
        starts, ends, pieces, spelled = self._matches(points, codes, stops)
        scores = np.append(self.scores, np.full(len(spelled), self.vocabulary.unknown_score))[pieces]

        # Matches with one start in a part end at different places, and those with an earlier start are longer: they come
        # first, so of equal sums the longer last piece stays.
        order = np.argsort(place[starts], kind="stable")
        starts, ends, pieces, scores = starts[order], ends[order], pieces[order], scores[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place[starts]))])
        best, back = np.full(len(points), -np.inf), np.zeros(len(points), np.int64)
        best[begins] = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            sums, to = best[starts[a:b]] + scores[a:b], ends[a:b]
            better = np.flatnonzero(sums > best[to])
            best[to[better]] = sums[better]
            back[to[better]] = better + a

        path, at = np.full(len(points), -1, np.int64), stops[lengths > 0]
        while len(at):
            last = back[at]
            at = starts[last]
            path[at] = pieces[last]
            at = at[place[at] > 0]
        return self._written(path, begins, spelled)

    def _matches(self, points: np.ndarray, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Start, end and number of all pieces found, and the byte ids of characters without a piece, numbered after the pieces."""
        live = np.delete(np.arange(len(points)), stops)
        nodes, size, found = np.zeros(len(live), np.int32), 0, []
        lone = np.ones(len(points), bool)
        lone[stops] = False
        while len(live):
            nodes = self.tree.step(nodes, codes[live + size])
            size += 1
            on = nodes >= 0
            live, nodes = live[on], nodes[on]
            piece = self.tree.piece[nodes]
            ends = piece >= 0
            found.append((live[ends], live[ends] + size, piece[ends]))
            if size == 1:
                lone[live[ends]] = False
        places = np.flatnonzero(lone)
        chars, which = np.unique(points[places], return_inverse=True)
        found.append((places, places + 1, len(self.scores) + which))
        starts, ends, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        return starts, ends, pieces.astype(np.int64), [self.vocabulary.byte_fallback(chr(c)) for c in chars.tolist()]

    def _written(self, path: np.ndarray, begins: np.ndarray, spelled: list[list[int]]) -> list[bytes]:
        """The ids of the pieces that stand at their starts, cut by part."""
        places = np.flatnonzero(path >= 0)
        pieces = path[places]
        ids = np.concatenate([self.ids, np.array([i for x in spelled for i in x], "<u4")])
        counts = np.append(np.ones(len(self.ids), np.int64), np.array([len(x) for x in spelled], np.int64))
        firsts, counts = (np.cumsum(counts) - counts)[pieces], counts[pieces]
        upto = np.concatenate([[0], np.cumsum(counts)])
        written = ids[np.repeat(firsts - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[np.append(np.searchsorted(places, begins), len(places))]).tolist()
        return [written[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class PieceCodec:
    """Encodes and decodes whole texts. Final ids of recurring parts between forced boundaries are remembered."""

    def __init__(self, model: bytes) -> None:
        self.vocabulary = PieceVocabulary(model)
        self.stream = ViterbiStream(self.vocabulary)
        self.side_by_side = SideBySide(self.vocabulary)
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}  # the parts remembered before `known` was last full

    def _parts(self, text: str) -> list[str]:
        """The parts of a text between forced boundaries; a space mark in the text itself is one of its own."""
        if not text:
            return []
        first, *others = f" {text}".split(SPACE)
        out = self.vocabulary.parts.findall(first)
        for piece in others:
            out.append(SPACE)
            out += self.vocabulary.parts.findall(piece)
        return out

    def _streamed(self, part: str) -> bytes:
        found = self.stream.feed(part.replace(" ", SPACE)) + self.stream.finish()
        return struct.pack(f"<{len(found)}I", *found)

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Remember the ids of all parts; those of long parts are returned instead."""
        if len(self.known) >= CACHED_WORDS:
            self.earlier, self.known = self.known, {}
        passing, fresh = {}, []
        for part in parts - self.known.keys():
            ids = self.earlier.get(part)
            if ids is not None:
                self.known[part] = ids
            elif part == SPACE:
                self.known[part] = np.array(self.vocabulary.byte_fallback(SPACE), "<u4").tobytes()
            elif len(part) >= 4 * self.vocabulary.longest:  # the stream commits ids on the way
                (self.known if len(part) <= 64 else passing)[part] = self._streamed(part)
            elif len(part) > 64:
                passing[part] = b""
                fresh.append(part)
            else:
                fresh.append(part)
        if fresh:
            for part, ids in zip(fresh, self.side_by_side.ids_of([p.replace(" ", SPACE) for p in fresh]), strict=True):
                (passing if part in passing else self.known)[part] = ids
        return passing

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of every text; none for an empty one. A space mark in a text itself is kept as bytes."""
        held, size = [], 0
        for text in texts:
            held.append(self._parts(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        passing = self._learn(set().union(*texts))
        known, other = self.known, passing.get
        for parts in texts:
            ids = [other(p) or known[p] for p in parts] if passing else map(known.__getitem__, parts)
            yield np.frombuffer(b"".join(ids), "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of encoded ids: bytes of all pieces, without the space put before the text."""
        table = self.vocabulary.table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


@functools.cache
def _codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"a model above {MAX_MODEL_BYTES} bytes")
    return model


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SUMMARY = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chars", pa.int64()), ("round_trip", pa.bool_()),
])


def _id_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row. Null and empty texts have no ids; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            held, first, size = [], 0, 0
            for i, ids in enumerate(codec.encode_all(text or "" for text in texts_of(batch))):
                held.append(ids)
                size += len(ids)
                if size > HELD_IDS or i == batch.num_rows - 1:
                    yield pa.record_batch([batch.column(0).slice(first, len(held)), _id_lists(held)], schema=_ENCODED)
                    held, first, size = [], i + 1, 0

    return ids_and_texts(docs, id_col, text_col).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids. Null and empty lists are empty texts."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            lists = (batch.column(1)[i] for i in range(batch.num_rows))
            texts = (codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in lists)
            yield from arrow_rows(zip(batch.column(0).to_pylist(), texts, strict=True), schema)

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(
        decode, "doc_id bigint, text string"
    )


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), n_chars, and
    round_trip: decoding the ids gives the text again; if asked for, ids.

    Defined results: null texts count as empty and have no ids; repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def batch_of(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMMARY, strict=True)]
        if not with_ids:
            return pa.record_batch(columns, schema=_SUMMARY)
        return pa.record_batch([*columns, _id_lists(ids)], names=[*_SUMMARY.names, "ids"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            rows, held, size = [], [], 0
            encoded = codec.encode_all(text or "" for text in texts_of(batch))
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), texts_of(batch), encoded, strict=True):
                rows.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), len(text or ""), codec.decode(ids) == (text or "")))
                held.append(ids)
                size += len(ids)
                if size > HELD_IDS:
                    yield batch_of(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield batch_of(rows, held)

    ddl = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, n_chars bigint, round_trip boolean" + ", ids array<int>" * with_ids
    return ids_and_texts(docs, id_col, text_col).mapInArrow(check, ddl)
