"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Patterns give candidates with their positions in code points. Every candidate's value is hashed,
and hashes are aggregated by distinct repositories and distinct owners over the whole corpus. A value
of WIDE_OWNERS owners or more is a widely copied example; the others look live. Beside the base
kinds, opaque tokens (MIN_OPAQUE characters or more, with a digit, a capital and a small letter) are
candidates; they become spans only if a single owner has them.

The owner is what stands before the first "/" of the repository name, or the whole name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.shared import Stored

WIDE_OWNERS = 3
MIN_SECRET = 6
MIN_OPAQUE = 20


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KINDS = ("assign", "access", "hex", "opaque")
KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the least lengths can stand in the patterns.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OPAQUE = f"[A-Za-z0-9+/_-]{{{MIN_OPAQUE},}}"

_NONE = "array<struct<kind:int,number:int,gap:int,size:int,value:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int, worth_a_look: Column) -> Column:
    """All leftmost non-overlapping matches: number, characters since the last match, size, value.

    The parts between matches, which split() gives, tell the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.transform(
        F.arrays_zip(whole.alias("m"), values.alias("v"), gaps.alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")
        ),
    )
    # the part after the last match has no match of its own
    return F.when(worth_a_look, F.filter(found, lambda x: x["size"].isNotNull())).otherwise(F.array().cast(_NONE))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """row, doc_id, repo and found (all pattern matches) of every row; texts stay behind."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"),
    )
    text = F.col("t")
    found = F.concat(
        _matches(text, 0, ASSIGN, 2, (text.contains("=") | text.contains(":")) & text.rlike(KEYWORDS)),
        _matches(text, 1, ACCESS, 0, text.contains("AKIA")),
        _matches(text, 2, HEX, 0, text.rlike("[0-9a-f]{24}")),
        _matches(text, 3, OPAQUE, 0, text.rlike(rf"(?=[A-Za-z0-9+/_-]{{{MIN_OPAQUE}}})[A-Za-z0-9+/_-]*[0-9]")),
    )
    return rows.select("row", "doc_id", "repo", found.alias("found"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    spans has kind:start:end of the spans by start and kind: all of the base kinds, and opaque tokens of fewer
    than `wide_owners` owners; base_sha256 is the digest of the same text for the base kinds. n_live and
    n_example count all candidates, opaque ones included, with fewer owners than that and with as many or more. Defined results: a null
    text is empty, and a null repository is one unnamed repository; repeated rows get equal results
    and add nothing to ownership; an empty table gives no rows; other columns are ignored.
    """
    rows = Stored(find_candidates(docs, id_col, text_col, repo_col), "secret-candidates").frame
    upto = Window.partitionBy("row", "kind").orderBy("number")
    start = F.sum(F.col("gap") + F.col("size")).over(upto) - F.col("size")
    value = F.col("value")
    opaque = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    wanted = F.when(F.col("kind") == 0, F.length("value") >= MIN_SECRET).when(F.col("kind") == 3, opaque).otherwise(F.lit(True))
    placed = (
        rows.filter(F.size("found") > 0).select("row", "repo", F.inline("found"))
        .withColumn("start", start).filter(wanted)
        .select("row", "repo", "kind", "start", (F.col("start") + F.col("size")).alias("end"), F.sha2(value, 256).alias("hash"))
    )
    candidates = Stored(placed, "secret-places").frame
    owned = candidates.select("hash", "repo").distinct().withColumn("owner", F.substring_index("repo", "/", 1))
    frequency = owned.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos")
    )
    judged = candidates.join(frequency, "hash")
    span = F.struct("start", "kind", "end", (F.col("owners") < wide_owners).alias("live"))
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    full = rows.select("row", "doc_id").join(per_row, "row", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>"))
    )
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("bigint")

    return full.select(
        "doc_id", *[count(_is_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"),
    )


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
