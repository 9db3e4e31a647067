"""The registered corpus queries, each over a whole table with production parameters, and SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontaminate,
    exact_dedup,
    language,
    pieces,
    prefix_trie,
    quality,
    repair,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
    unit_dedup,
)
from ledgerloom.llm.common import documents, held_out

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.repeated_units(documents(spark, sf_dir), min_words=1)
    written = F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["stop"].cast("string")))
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", F.array_join(written, ",").alias("spans"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir), PIECE_MODEL)


def op9_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_on_disk(documents(spark, sf_dir), WORD_VOCABULARY)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify_languages(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair_summary(repair.damage(table), table)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.family_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_pairwise_quality, op3_line_dedup, op4_suffix_array_dedup, op5_secret_ownership,
        op6_simhash_decontamination, op7_golomb_exact_dedup, op8_streaming_viterbi, op9_packed_token_files, op10_language_mixture,
        op11_jump_shards, op12_checkpointed_repair, op13_prefix_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit FROM documents
), placed AS (
  SELECT doc_id, unit, length(line) AS size,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS start,
         trim(regexp_replace({_LOWER.replace("coalesce(text, '')", "line")}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS normal FROM split
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY normal ORDER BY doc_id, unit) AS place FROM placed
)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE place > 1 AND normal <> '') AS n_removed,
       coalesce(sum(size) FILTER (WHERE place > 1 AND normal <> ''), 0)::BIGINT AS removed_chars,
       coalesce(string_agg(start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start)
         FILTER (WHERE place > 1 AND normal <> ''), '') AS spans
FROM ranked GROUP BY doc_id
"""

_OP7 = f"""
WITH normal AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
"""


def _op5_kind(kind: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, repo, {kind} AS kind, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS v,"
        f" string_split_regex(t, '{quoted}') AS g FROM texts"
    )


_OP5 = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join([
    _op5_kind(0, secret_scan.ASSIGN, 2), _op5_kind(1, secret_scan.ACCESS, 0), _op5_kind(2, secret_scan.HEX, 0), _op5_kind(3, secret_scan.OPAQUE, 0),
])}),
each AS (SELECT doc_id, repo, kind, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m))::BIGINT AS s FROM each
), wanted AS (
  SELECT doc_id, repo, kind, s, s + length(m) AS e, v FROM placed
  WHERE CASE kind WHEN 0 THEN length(v) >= {secret_scan.MIN_SECRET}
             WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END
), owned AS (SELECT v, count(DISTINCT split_part(repo, '/', 1)) AS owners FROM wanted GROUP BY v),
spans AS (
  SELECT doc_id, kind, s, owners, kind < 3 OR owners < {secret_scan.WIDE_OWNERS} AS listed, (CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END) || ':' || s || ':' || e AS w
  FROM wanted JOIN owned USING (v)
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
         string_agg(w, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(w, ',' ORDER BY s, kind) FILTER (WHERE listed) AS spans,
         count(*) FILTER (WHERE owners < {secret_scan.WIDE_OWNERS}) AS live, count(*) FILTER (WHERE owners >= {secret_scan.WIDE_OWNERS}) AS example
  FROM spans GROUP BY doc_id
)
SELECT texts.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example
FROM texts LEFT JOIN per_doc USING (doc_id)
"""

# The checksum of a text by its bytes and the table that the polynomial gives.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n::UINTEGER, [x::UINTEGER FOR x IN range(8)]),
      lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UINTEGER) ELSE a >> 1 END) AS c FROM range(256) r(n))
)"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, next to crc_table."""
    digits = f"hex(encode({text}))"
    return (
        f"xor(list_reduce(list_prepend(4294967295::UINTEGER, [('0x' || substr({digits}, 2 * i + 1, 2))::UINTEGER"
        f" FOR i IN range(length({digits}) // 2)]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)")


_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, jumps AS (
  SELECT doc_id, -1::BIGINT AS b, 0::BIGINT AS j, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0) END)::UHUGEINT AS k
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (((k * {sharding.MULTIPLIER} + 1) % 18446744073709551616 // 8589934592) + 1)::DOUBLE))::BIGINT,
         (k * {sharding.MULTIPLIER} + 1) % 18446744073709551616
  FROM jumps WHERE j < {sharding.SHARDS}
), reached AS (
  SELECT doc_id, max(b)::INTEGER AS shard, max(j) AS j FROM jumps GROUP BY doc_id
), sized AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(strlen(text), 0) + 1 AS size FROM documents
), summed AS (
  SELECT doc_id, size::BIGINT AS size, CASE WHEN h = '' THEN 0 ELSE {_crc("coalesce(text, '')").replace("hex(encode(coalesce(text, '')))", "h")} END::BIGINT AS text_crc32
  FROM sized, crc_table
)
SELECT summed.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY summed.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CASE WHEN j = {sharding.SHARDS} THEN {sharding.SHARDS} ELSE shard END::INTEGER AS grown_shard
FROM summed JOIN reached ON summed.doc_id IS NOT DISTINCT FROM reached.doc_id
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DIGEST = "sha256(length(role)::VARCHAR || ':' || role || text)"

_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS i,
         left(role, 1) AS initial, right(rtrim(text, {_SPACE}), 1) AS final FROM damaged
), marked AS (
  SELECT *, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ordered
), inserts(q, p, put, lines, cost) AS (  -- turns put in before a row: state, state after
  VALUES ('', '', '', '', 0), ('', 'u', 'I', chr(10) || 'user:', 5), ('', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10),
         ('s', 's', '', '', 0), ('s', 'u', 'I', chr(10) || 'user:', 5), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10),
         ('u', 'u', '', '', 0), ('u', 'a', 'I', chr(10) || 'assistant:', 5),
         ('a', 'a', '', '', 0), ('a', 'u', 'I', chr(10) || 'user:', 5)
), steps(p, initial, t, letter, cost) AS (  -- what may happen to a row: state, its initial (any if null), state after
  VALUES ('', 's', 's', 'K', 0), ('', 'u', 'u', 'K', 0), ('s', 'u', 'u', 'K', 0), ('u', 'a', 'a', 'K', 0), ('a', 'u', 'u', 'K', 0),
         ('', NULL, 'u', 'R', 1), ('s', NULL, 'u', 'R', 1), ('u', NULL, 'a', 'R', 1), ('a', NULL, 'u', 'R', 1),
         ('', NULL, '', 'D', 2), ('s', NULL, 's', 'D', 2), ('u', NULL, 'u', 'D', 2), ('a', NULL, 'a', 'D', 2)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM marked)
  UNION ALL
  SELECT w.conv_id, w.i + 1, s.t, min({{
    'cost': (w.best.cost + n.cost + s.cost + CASE WHEN m.fault = 3 AND s.letter <> 'D' THEN 5 ELSE 0 END)::BIGINT,
    'audit': w.best.audit || n.put || s.letter,
    'lines': w.best.lines || n.lines || CASE s.letter WHEN 'K' THEN chr(10) || m.role || ':' || m.text
             WHEN 'R' THEN chr(10) || CASE s.t WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text ELSE '' END}})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
  JOIN inserts n ON n.q = w.q
  JOIN steps s ON s.p = n.p AND (s.initial IS NULL OR s.initial = m.initial) AND (m.fault NOT IN (1, 2) OR s.letter = 'D')
  GROUP BY w.conv_id, w.i, s.t
), counts AS (
  SELECT conv_id, count(*) AS n, (max(turn) - min(turn) + 1 - count(DISTINCT turn)) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({{'cost': (w.best.cost + n.cost)::BIGINT, 'audit': w.best.audit || n.put, 'lines': w.best.lines || n.lines}}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.q = w.q AND n.p IN ('', 'a')
  GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), own AS (
  SELECT conv_id, {_DIGEST} AS d, length(text) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) - 1 AS i FROM plain
), convs AS (
  SELECT conv_id, count(*) AS n, CASE WHEN conv_id IS NULL THEN 0 ELSE {_crc("coalesce(conv_id, 0)::VARCHAR")} % {prefix_trie.SHARED_TURNS} END AS h,
         conv_id - conv_id % {prefix_trie.FAMILY} AS base
  FROM own, crc_table GROUP BY conv_id, tab
), built AS (
  SELECT c.conv_id, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), turns AS (
  SELECT c.conv_id, o.i, o.d, o.chars FROM convs c JOIN own o ON o.conv_id = c.base AND o.i < c.h
  UNION ALL
  SELECT o.conv_id, o.i - b.h + b.taken, o.d, o.chars FROM own o JOIN built b ON b.conv_id IS NOT DISTINCT FROM o.conv_id WHERE o.i >= b.h
), members AS (
  SELECT conv_id, i + 1 AS depth, sha256(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY i)) AS node, chars FROM turns
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
), linked AS (
  SELECT m.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM members m
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE final), '')) AS ends_sha256
  FROM linked GROUP BY node
), fanout AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
totals AS (  -- each node counts for the prefixes of its smallest member
  SELECT m.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN fanout f ON f.parent = n.node JOIN members m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.depth <= n.depth
  GROUP BY m.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN totals USING (node) LEFT JOIN fanout f ON f.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
"""

SQL = {
    "op3_line_dedup": _OP3, "op5_secret_ownership": _OP5, "op7_golomb_exact_dedup": _OP7,
    "op11_jump_shards": _OP11, "op12_checkpointed_repair": _OP12, "op13_prefix_trie": _OP13,
}
