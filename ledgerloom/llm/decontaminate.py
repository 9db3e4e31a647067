"""Benchmark decontamination with SimHash windows. DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (a text with fewer is one
shingle). A document is searched with windows of the size of each benchmark item:

1. A window can only reach the similarity if it holds a certain number of the item's shingles: with
   m shingles in the item and w in the window, at least MIN_SIMILARITY * (m + w) / (1 + MIN_SIMILARITY).
   All windows that do are kept, no other is; this loses nothing.
2. Every such window gets a SimHash fingerprint. Fingerprints of RADIUS bits or fewer apart agree on at
   least one of RADIUS + 1 blocks, so windows and items of the same size are joined on the blocks and
   all pairs within the radius are found.
3. The weighted Jaccard similarity of the shingles of each pair decides. Shingles are compared by
   64-bit hashes and counted as often as they occur.

The benchmark's distinct shingle hashes are broadcast if there are at most BROADCAST_HASHES (16 bytes
each); a larger benchmark uses a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.shared import Stored

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 16
BROADCAST_HASHES = 2_000_000


def with_shingle_hashes(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """The rows with the hashes of all shingles of a text in order, in place of the text.

    The words are a column of their own: inside the loop over shingles they would be split again each time.
    """
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    others = [c for c in rows.columns if c != text_col]
    words = rows.select(*others, F.filter(parts, lambda w: w != "").alias("_words"))
    hashes = F.when(F.size("_words") == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_words") - (SHINGLE_WORDS - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice("_words", i, SHINGLE_WORDS)),
        )
    )
    return words.select(*others, hashes.alias(name))


def _fingerprint(hashes: str) -> Column:
    """The majority bits of an array of hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(2 * size(filter({hashes}, h ->"
        f" (shiftrightunsigned(h, b) & 1L) = 1L)) > size({hashes}), shiftleft(1L, b), 0L))"
    )


def _blocks(fingerprint: str) -> Column:
    """Numbered blocks of a fingerprint; equal numbers mean the same block with the same bits."""
    n = RADIUS + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*[
        F.shiftrightunsigned(fingerprint, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1) * n + k for k in range(n)
    ])


def prepare_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, m, item_hashes, item_print. Rows with a null id or without words can't be found and are left out."""
    texts = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = with_shingle_hashes(texts, "text", "item_hashes").filter("item_id is not null and size(item_hashes) > 0").distinct()
    return items.select("item_id", F.size("item_hashes").alias("m"), "item_hashes", _fingerprint("item_hashes").alias("item_print"))


def _hits(texts: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, item_id, m, position: where documents hold a shingle of an item."""
    hashes = item_shingles.select("h").distinct()
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    named = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # outer, as explode() alone adds a filter on the size of the array, which repeats all of its work
    places = (
        with_shingle_hashes(named, "text", "hashes")
        .select("doc_id", "text_hash", F.size("hashes").alias("n"), F.posexplode_outer("hashes").alias("position", "h"))
        .join(hashes, "h", "left_semi")
    )
    return Stored(places.distinct(), "benchmark-hits").frame.join(item_shingles, "h").drop("h")


def _starts() -> Column:
    """All windows of w shingles with at least `need` hits, from the ascending positions `at`, each once."""
    return F.expr(
        "flatten(transform(sequence(0, size(at) - need), i -> if("
        " greatest(if(i = 0, 0, at[i - 1] + 1), at[i + need - 1] - w + 1) <= least(at[i], n - w),"
        " sequence(greatest(if(i = 0, 0, at[i - 1] + 1), at[i + need - 1] - w + 1), least(at[i], n - w)),"
        " cast(array() as array<int>))))"
    )


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    common = (
        f"if(size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})),"
        f" aggregate(array_intersect({a}, {b}), 0, (t, x) -> t + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))))"
    )
    return F.expr(f"transform(array({common}), c -> c / cast(size({a}) + size({b}) - c as double))[0]")


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, similarity (the best window) of every document and item at MIN_SIMILARITY or more."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    items = Stored(prepare_items(benchmark, item_col, item_text_col), "benchmark-items").frame
    shingles = items.select("item_id", "m", F.explode(F.array_distinct("item_hashes")).alias("h"))
    per_item = (
        _hits(texts, shingles).groupBy("doc_id", "text_hash", "n", "item_id", "m")
        .agg(F.count("*").alias("hits"), F.sort_array(F.collect_list("position")).alias("at"))
        .withColumn("w", F.least("m", "n"))
        # rounding keeps the exact bound where the product of floating-point numbers is a hair above it
        .withColumn("need", F.greatest(F.expr(f"cast(ceil(round({MIN_SIMILARITY / (1 + MIN_SIMILARITY)!r} * (m + w), 9)) as int)"), F.lit(1)))
        .filter("hits >= need")
    )
    wanted = Stored(
        per_item.select("doc_id", "text_hash", "m", "w", F.explode_outer(_starts()).alias("start")).filter("start is not null").distinct()
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("m", "w", "start")).alias("windows")),
        "wanted-windows",
    ).frame
    joined = texts.alias("t").join(wanted.alias("x"), F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("t.text") == F.col("x.text_hash")))
    cut = (
        with_shingle_hashes(joined.select("t.doc_id", "x.text_hash", "x.windows", "t.text"), "text", "hashes")
        .select("doc_id", "text_hash", "hashes", F.inline("windows"))
        .select("doc_id", "text_hash", "m", F.expr("slice(hashes, start + 1, w)").alias("part"))
        .select(F.monotonically_increasing_id().alias("window"), "doc_id", "text_hash", "m", "part", _fingerprint("part").alias("print"))
    )
    windows = Stored(cut, "windows").frame
    mine = windows.select("window", "m", "print", F.explode(_blocks("print")).alias("block"))
    theirs = items.select("item_id", F.col("m").alias("item_m"), "item_print", F.explode(_blocks("item_print")).alias("item_block"))
    near = (
        mine.join(theirs, (F.col("m") == F.col("item_m")) & (F.col("block") == F.col("item_block")))
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("window", "item_id").distinct()
    )
    pairs = near.join(windows.select("window", "doc_id", "text_hash", "part"), "window").join(items.select("item_id", "item_hashes"), "item_id")
    judged = pairs.select("doc_id", "text_hash", "item_id", _similarity("part", "item_hashes").alias("similarity"))
    return judged.filter(F.col("similarity") >= MIN_SIMILARITY).groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (ascending), similarity (the best, or null).

    Defined results: null, empty and wordless texts are clean; an item or document with fewer than five
    words is one shingle, so they match as wholes; a document shorter than an item is one window; equal
    rows get equal results; items of equal text are all named; an empty benchmark finds nothing; an
    empty table gives no rows; other columns are ignored.
    """
    matches = benchmark_matches(docs, benchmark, id_col, text_col, item_col, item_text_col)
    found = Stored(
        matches.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity")),
        "contaminated",
    ).frame
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text_hash")
    )
    joined = rows.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    return joined.select(
        "a.doc_id", F.col("b.item_ids").isNotNull().alias("contaminated"),
        F.greatest(F.size("b.item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("b.item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "b.similarity",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item of the benchmark."""
    found = Stored(benchmark_matches(docs, benchmark, id_col, text_col, item_col, item_text_col).select("doc_id", "text_hash").distinct(), "leaks").frame
    text_hash = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    return docs.alias("d").join(
        found.alias("x"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("x.doc_id")) & (text_hash == F.col("x.text_hash")), "left_anti"
    )
