"""Cheapest repair of the order of roles in conversations.

Role initials must read (s?(ua)+)?. A cost per state (nothing yet, after s, after u, after a) is
carried back from the end of a conversation. Only the cost vectors at every square root of the
rows are stored; walking forward, the vectors of one stretch are computed again from the
checkpoint behind it, and the first letter that keeps the cheapest cost is taken, which gives
the ASCII-least of the cheapest edits.

Rows are sorted over range partitions and cut into blocks. A conversation inside a block is
solved there. One that crosses a block's edge is solved per piece: a 4 x 4 matrix of costs per
piece, then the cost vectors between the pieces (checkpoints of a second level), then a walk of every
piece from each of the four states, of which the one that the piece before ends in counts. So a
conversation that holds a third of all rows is spread over tasks; one row per piece meets in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows
from ledgerloom.llm.turns import turn_digest, turns_of
from ledgerloom.plans.shared import Stored

#: Rows of a block, as a power of two.
BLOCK_BITS = 16

# What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_NONE, _S, _U, _A = range(4)
#: The state after a user or assistant is put in, by state.
_FORCED = (_U, _U, _A, _U)
#: The state after a kept row of initial s, u, a or another, by state; None where it may not follow.
_KEPT = ((_S, _U, None, None), (None, _U, None, None), (None, None, _A, None), (None, _U, None, None))
_FAR = 1 << 60
#: Cost from each state to the end of a conversation without further rows.
_END = (0, 2 * INSERT, INSERT, 0)
_NAMES = {_U: "user", _A: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
# A row's code: initial (0 to 3), 4 if it must go, 8 if it is truncated.
_MUST_GO, _CUT = 4, 8

Vector = tuple[int, int, int, int]


def _before(code: int, after: Sequence[int]) -> Vector:
    """The cost vector before a row, from the one behind it."""
    extra = TRUNCATED if code & _CUT else 0
    base = []
    for state in range(4):
        best = DELETE + after[state]
        if not code & _MUST_GO:
            kept = _KEPT[state][code & 3]
            if kept is not None:
                best = min(best, extra + after[kept])
            best = min(best, REROLE + extra + after[_FORCED[state]])
        base.append(best)
    # No more than two turns put in a row are of use: a third leads back to a state passed.
    return tuple(
        min(base[q], INSERT + base[_FORCED[q]], 2 * INSERT + base[_FORCED[_FORCED[q]]]) for q in range(4))


class Backward:
    """Costs from every row of a piece to its end, kept at checkpoints only."""

    def __init__(self, codes: bytes, end: Vector) -> None:
        self.codes, self.end, self.stride = codes, end, isqrt(len(codes)) + 1
        self.marks: dict[int, Vector] = {}
        vector = end
        for i in range(len(codes) - 1, -1, -1):
            vector = _before(codes[i], vector)
            if i % self.stride == 0:
                self.marks[i] = vector
        self.start = vector

    def stretches(self) -> Iterator[tuple[int, list[Vector]]]:
        """(first row, vectors before its rows and one behind), one stretch after the other."""
        for low in range(0, len(self.codes), self.stride):
            high = min(low + self.stride, len(self.codes))
            vectors = [self.marks.get(high, self.end)]
            for i in range(high - 1, low - 1, -1):
                vectors.append(_before(self.codes[i], vectors[-1]))
            yield low, vectors[::-1]

    def walk(self, state: int, last: bool) -> tuple[str, int]:
        """The ASCII-least cheapest edits from a state, and the state they end in."""
        letters: list[str] = []
        for low, vectors in self.stretches():
            for k in range(len(vectors) - 1):
                code, here, after = self.codes[low + k], vectors[k], vectors[k + 1]
                while here[state] != DELETE + after[state] and here[state] == INSERT + here[_FORCED[state]]:
                    letters.append("I")
                    state = _FORCED[state]
                if here[state] == DELETE + after[state]:
                    letters.append("D")
                    continue
                extra = TRUNCATED if code & _CUT else 0
                kept = _KEPT[state][code & 3]
                if kept is not None and here[state] == extra + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = _FORCED[state]
        while last and state in (_S, _U):
            letters.append("I")
            state = _FORCED[state]
        return "".join(letters), state


def matrix(codes: bytes) -> list[int]:
    """The cost from every state before a piece to every state behind it, row by row."""
    to = [Backward(codes, tuple(0 if q == target else _FAR for q in range(4))).start for target in range(4)]
    return [min(to[target][state], _FAR) for state in range(4) for target in range(4)]


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("row", pa.int64()), ("open", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("final", pa.int32()), ("cost", pa.int64()),
    ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("codes", pa.binary()),
])
_PIECE_DDL = (
    "conv_id bigint, row bigint, open boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first int, final int, cost bigint, audit string, costs array<bigint>, codes binary")


def _solve_block(table: pa.Table) -> pa.Table:
    """One row per piece of a conversation in the block; pieces inside it come with their edits."""
    rows = table.sort_by("row").select(["conv_id", "row", "initial", "fault"]).to_pydict()
    ids, places, initials, faults = rows["conv_id"], rows["row"], rows["initial"], rows["fault"]
    edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    out = []
    for low, high in zip(edges, edges[1:]):
        codes = bytes(
            c | (_MUST_GO if f in (1, 2) else _CUT if f == 3 else 0) for c, f in zip(initials[low:high], faults[low:high]))
        counts = [faults[low:high].count(f) for f in (1, 2, 3)]
        illegal = sum((a, b) not in _LEGAL for a, b in zip(initials[low:high], initials[low + 1 : high]))
        found = [ids[low], places[low], low == 0 or high == len(ids), *counts, illegal, initials[low], initials[high - 1]]
        if found[2]:
            out.append((*found, 0, None, matrix(codes), codes))
        else:
            back = Backward(codes, _END)
            out.append((*found, back.start[_NONE], back.walk(_NONE, True)[0], None, None))
    return pa.Table.from_batches(list(arrow_rows(out, _PIECE)), _PIECE)


_CHAINED = pa.schema([
    ("conv_id", pa.int64()), ("row", pa.int64()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()),
    ("cost", pa.int64()), ("illegal", pa.int64())])


def _chain_costs(table: pa.Table) -> pa.Table:
    """The cost vector behind every piece of a conversation; cost and illegal pairs between pieces."""
    pieces = table.sort_by("row").to_pylist()
    out, vector = [], _END
    for i in range(len(pieces) - 1, -1, -1):
        costs, last = pieces[i]["costs"], i == len(pieces) - 1
        illegal = int(not last and (pieces[i]["final"], pieces[i + 1]["first"]) not in _LEGAL)
        behind, vector = vector, tuple(min(costs[4 * q + t] + vector[t] for t in range(4)) for q in range(4))
        out.append((pieces[i]["conv_id"], pieces[i]["row"], list(behind), last, vector[_NONE] if i == 0 else 0, illegal))
    return pa.Table.from_batches(list(arrow_rows(out, _CHAINED)), _CHAINED)


_WALKED = pa.schema([
    ("conv_id", pa.int64()), ("row", pa.int64()), ("exits", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])


def _walk_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk of a piece from each of the four states."""
    def walked() -> Iterator[tuple]:
        for batch in batches:
            for piece in batch.to_pylist():
                back = Backward(piece["codes"], tuple(piece["behind"]))
                walks = [back.walk(state, piece["last"]) for state in range(4)]
                yield piece["conv_id"], piece["row"], [w[1] for w in walks], [w[0] for w in walks]

    yield from arrow_rows(walked(), _WALKED, 16)


_ENTERED = pa.schema([("row", pa.int64()), ("entry", pa.int32())])


def _chain_states(table: pa.Table) -> pa.Table:
    """The state in which the walk enters every piece of a conversation."""
    out, state = [], _NONE
    for piece in table.sort_by("row").to_pylist():
        out.append((piece["row"], state))
        state = piece["exits"][state]
    return pa.Table.from_batches(list(arrow_rows(out, _ENTERED)), _ENTERED)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32("conv_id:turn") % 20.

    0 drops the row, 1 empties its text, 2 takes the characters .!? out, 3 repeats the row, 4 sets the role
    user. A null in any column counts as one space, but a null turn stays null as a turn.
    """
    rows = turns_of(conversations)
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind != 0")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _sorted_rows(turns: DataFrame) -> Stored:
    """The rows in global order with the number `row`, their digest, initial and faults of their own."""
    space = " \t\n\v\f\r"
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns_of(turns).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "digest": turn_digest(F.col("role"), F.col("text")),
        "initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
        "last": F.right(F.rtrim(F.col("text"), F.lit(space)), F.lit(1)),
        # Rows that agree in all else are the same to every result; this spreads them.
        "tie": F.monotonically_increasing_id(),
    })
    order = ["conv_id", "turn", "digest", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return Stored(ranged.select(
        "conv_id", "turn", "role", "text", "digest", "initial",
        F.when(F.col("last") == "", 1).when(F.col("last").isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
        F.monotonically_increasing_id().alias("row")), "turns")


class Repair:
    """A repair of conversations (columns conv_id, turn, role, text), computed on creation.

    Rows are taken by turn (nulls first), rows of one turn by the digest of role and text. Defined results: a null role
    or text is one space; rows of a null conv_id are one conversation; repeated rows are duplicates;
    an empty table gives no rows; other columns are ignored, whatever their names; texts and
    conversations may have any length, as tasks hold codes of a block's rows and one batch of texts. The
    audit of a conversation is one value of its result, so it has to fit one.
    """

    def __init__(self, turns: DataFrame, block_bits: int = BLOCK_BITS) -> None:
        self.block_bits = block_bits
        self._rows = _sorted_rows(turns)
        rows = self._rows.frame
        # Only digests that occur more than once in their conversation come back.
        first = rows.groupBy("conv_id", "digest").agg(F.min("row").alias("earliest"), F.count("*").alias("n")).where("n > 1")
        slim = rows.select("conv_id", "digest", "row", "initial", "fault").alias("r").join(
            first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.digest") == F.col("f.digest")), "left")
        repeated = (F.col("r.fault") != 1) & F.coalesce(F.col("r.row") > F.col("f.earliest"), F.lit(False))
        marked = slim.select(
            "r.conv_id", "r.row", "r.initial", F.when(repeated, 2).otherwise(F.col("r.fault")).alias("fault"),
            F.shiftright("r.row", block_bits).alias("block"))
        self._pieces = Stored(marked.groupBy("block").applyInArrow(_solve_block, _PIECE_DDL), "pieces")
        pieces = self._pieces.frame
        crossing = pieces.where("open")
        self._chained = Stored(
            crossing.select("conv_id", "row", "costs", "first", "final").groupBy("conv_id").applyInArrow(
                _chain_costs, "conv_id bigint, row bigint, behind array<bigint>, last boolean, cost bigint, illegal bigint"), "chained")
        walked = Stored(
            crossing.select("row", "codes").join(self._chained.frame, "row").select("conv_id", "row", "codes", "behind", "last")
            .mapInArrow(_walk_pieces, "conv_id bigint, row bigint, exits array<int>, audits array<string>"), "walked")
        entries = walked.frame.select("conv_id", "row", "exits").groupBy("conv_id").applyInArrow(
            _chain_states, "row bigint, entry int")
        picked = walked.frame.join(entries, "row").select("conv_id", "row", "entry", F.col("audits")[F.col("entry")].alias("audit"))
        self._edits = Stored(picked.unionByName(
            pieces.where("not open").select("conv_id", "row", F.lit(_NONE).alias("entry"), "audit")), "edits")
        walked.drop()

    def drop(self) -> None:
        for stored in (self._rows, self._pieces, self._chained, self._edits):
            stored.drop()

    def _with_edits(self) -> DataFrame:
        """Rows and edits of pieces in one table: the edits of a piece stand before its rows."""
        none = F.lit(None)
        return self._rows.frame.select(
            "conv_id", "row", F.lit(1).alias("kind"), "turn", "role", "text", none.cast("int").alias("entry")
        ).unionByName(self._edits.frame.select(
            "conv_id", "row", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
            F.col("audit").alias("text"), "entry"))

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, row and part (their order), turn, role, text, edit (K, R or I)."""
        table = self._with_edits().withColumn("block", F.shiftright("row", self.block_bits))
        return table.repartition("block").sortWithinPartitions("row", "kind").drop("block").mapInArrow(
            _repaired_turns, "conv_id bigint, row bigint, part int, turn bigint, role string, text string, edit string")

    def summary(self) -> DataFrame:
        """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        turns = self._rows.frame.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
        wide = "decimal(38,0)"
        span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.sum("one").cast(wide)
        gaps = turns.groupBy("conv_id").agg(F.least(span, F.lit(2**63 - 1).cast(wide)).cast("long").alias("gaps"))
        counts = self._pieces.frame.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")
        between = self._chained.frame.select("conv_id", "illegal", "cost")
        ends = self._with_edits().repartition("conv_id").sortWithinPartitions("conv_id", "row", "kind").mapInArrow(
            _digests, "conv_id bigint, audit string, repaired_sha256 string")
        every = counts
        for part in (between, gaps, ends):
            every = every.unionByName(part, allowMissingColumns=True)
        return every.groupBy("conv_id").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.max("audit").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row, part, turn, role, text, edit) in order; an audit comes as (conv_id, row, None, ..., audit)."""
    conv, letters, at, state, last, part = None, "", 0, _NONE, 0, 0

    def put_in() -> Iterator[tuple]:
        nonlocal at, state, part
        while at < len(letters) and letters[at] == "I":
            state = _FORCED[state]
            yield conv, last, part, None, _NAMES[state], "", "I"
            at, part = at + 1, part + 1

    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in columns.items()}
            if row["kind"] == 0:
                yield from put_in()  # what the piece before puts in after its last row
                conv, letters, at, state, last, part = row["conv_id"], row["text"], 0, row["entry"], row["row"], 0
                yield conv, last, None, None, None, letters, None
                continue
            last, part = row["row"], 0
            yield from put_in()
            edit, at = letters[at], at + 1
            if edit == "K":
                state = _KEPT[state]["sua".find(row["role"][:1]) if row["role"][:1] else 3]
            elif edit == "R":
                state = _FORCED[state]
            if edit != "D":
                yield conv, last, part, row["turn"], _NAMES[state] if edit == "R" else row["role"], row["text"], edit
                part += 1
    yield from put_in()


_TURNS = pa.schema([
    ("conv_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("edit", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from arrow_rows((r for r in _edited(batches) if r[2] is not None), _TURNS, 256)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its texts pass through the hash one by one."""
    def digested() -> Iterator[tuple]:
        conv, audits, sha, some = None, None, None, False
        for conv_id, _, part, _, role, text, _ in _edited(batches):
            if part is None:
                if audits is None or conv_id != conv:
                    if audits is not None:
                        yield conv, "".join(audits), sha.hexdigest()
                    conv, audits, sha, some = conv_id, [], hashlib.sha256(), False
                audits.append(text)
                continue
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
        if audits is not None:
            yield conv, "".join(audits), sha.hexdigest()

    yield from arrow_rows(digested(), _DIGESTS, 256)


def repair_summary(turns: DataFrame, conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The summary of a repair of `turns`, with a row for every conv_id of `conversations`.

    A conversation without any row in `turns` has zeros, an empty audit and the hash of an empty string.
    """
    repaired = Repair(turns, block_bits).summary()
    every = turns_of(conversations).select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return repaired.unionByName(every, allowMissingColumns=True).groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
