"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    sharded = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def tokenizer_path() -> str:
    """The word-level tokenizer file, where this machine's public tokenizers are."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), 100).drop("kept")


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *base, "base_failed", "kept", "p_good")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import Manifest

    rows = Manifest(table(spark, sf_dir, "documents")).rows()
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("d1", "d2")


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), 20, 20)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w FROM s),
o AS (
  SELECT source, source_size, w, row_number() OVER p AS k,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () * 1.5::DOUBLE AS whole
  FROM w WINDOW p AS (ORDER BY source_size / w, source NULLS LAST)),
l AS (SELECT *, (whole - capped) / open_w AS level FROM o),
t AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, (SELECT level FROM l WHERE source_size * 2.0 >= level * w ORDER BY k LIMIT 1) * w) AS target
  FROM l),
x AS (
  SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
         CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM e
"""

_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
#: The unsigned CRC-32 of a whole number's decimal digits.
_CRC = f"xor({_CRC}, 4294967295)"

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS n, lang, text,
         CASE WHEN CRC % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
p AS (
  SELECT *, coalesce(octet_length(encode(i)) || ':' || i, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n)) || ':' || n, '-') AS head FROM d),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) AS altered FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
nodes AS (
  SELECT s, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM r
  UNION ALL
  SELECT s, min(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (min(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY s, place // 3),
subroots AS (SELECT s, level, h FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, s AS place, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT min(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (min(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY place // 3),
every AS (
  SELECT s, level, place, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT s, b.level + tops.level, tops.place, tops.h FROM tops, (SELECT s, level FROM subroots) b WHERE n > 1),
walk AS (
  SELECT r.s, r.place AS row_place, r.place, 0 AS level, altered AS node, '' AS proof, (SELECT level FROM subroots b WHERE b.s = r.s) AS height FROM r
  UNION ALL
  SELECT w.s, w.row_place, u.parent, w.level + 1, sha256(u.a || w.node || u.b), w.proof || u.a || u.b, w.height
  FROM (SELECT *, CASE WHEN level = height THEN s ELSE place END AS at FROM walk) w
  JOIN (
    SELECT m.s, m.level, m.place, m.place // 3 AS parent, coalesce(string_agg(x.h, '' ORDER BY x.place) FILTER (x.place < m.place), '') AS a,
           coalesce(string_agg(x.h, '' ORDER BY x.place) FILTER (x.place > m.place), '') AS b
    FROM every m JOIN every x ON x.s = m.s AND x.level = m.level AND x.place // 3 = m.place // 3 GROUP BY m.s, m.level, m.place) u
  ON u.s = w.s AND u.level = w.level AND u.place = w.at),
last AS (SELECT s, row_place, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM walk GROUP BY s, row_place)
SELECT r.doc_id, r.leaf, b.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, k.proof_sha256, k.folded_root, k.folded_root = (SELECT h FROM tops WHERE n = 1) AS verified
FROM r JOIN subroots b ON b.s = r.s JOIN last k ON k.s = r.s AND k.row_place = r.place
""".replace("CRC", _CRC.format("doc_id"))

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS i, m, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CRC % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS kind, t.i, t.m, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.m, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(m, '') OVER (w ROWS UNBOUNDED PRECEDING) AS node, chars,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY kind, i)),
every AS (
  SELECT conv_id, depth, node, chars, turns FROM p
  UNION ALL
  SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) FROM c),
n AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM every GROUP BY node),
k AS (SELECT left(node, CAST(32 * (depth - 1) AS BIGINT)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (
  SELECT left(node, CAST(32 * up AS BIGINT)) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (node) LEFT JOIN n u ON v.depth > 0 AND u.node = left(v.node, CAST(32 * (v.depth - 1) AS BIGINT))
""".replace("CRC", _CRC.format("conv_id"))

QUERIES: dict[str, Query] = {
    "op1_pivot_permutation": op1_pivot_permutation,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_token_group_join": op3_token_group_join,
    "op4_sharding": op4_sharding,
    "op5_mixture_language": op5_mixture_language,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_site_templates": op8_site_templates,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collision_counting": op13_collision_counting,
}
ORACLE_SQL: dict[str, str] = {"op10_mixing": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_prefix_trie": OP12_SQL}
