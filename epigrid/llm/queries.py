"""The registered queries of this subpackage: one a dealt operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import FIRST, LOW, ROUNDS, SECOND, round_keys


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import default_vocabulary

    return pack_documents(_docs(spark, sf_dir), default_vocabulary(), capacity=2048, end_id=0)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_docs(spark, sf_dir), weights=(5, 2, 1), share=1.5, repeats=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_edited, sample_edits
    from .tokens import default_vocabulary

    return count_edited(_docs(spark, sf_dir).withColumn("edits", sample_edits(F.col("text"))), default_vocabulary())


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    clean = drop_boilerplate(_docs(spark, sf_dir), host="source", ratio=LINE_RATIO, least_pages=3)
    return clean.select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: The share of a site's pages from which on a line is boilerplate.
LINE_RATIO = 0.1

OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, source, i, line, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
b AS (
  SELECT l.source, l.bare FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE l.bare <> ''
  GROUP BY l.source, l.bare, t.n HAVING count(DISTINCT l.doc_id) >= 3 AND count(DISTINCT l.doc_id) > {LINE_RATIO} * t.n),
m AS (
  SELECT l.doc_id, l.i, l.line, b.bare IS NOT NULL AS bad
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE bad) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.removed_lines, 0) AS removed_lines, length(k.kept) AS kept_chars, sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Workspace
    from .hamming_search import nearest_codes, sign_codes

    # Written once: the codes are read as index and as queries.
    codes = Workspace(spark, "codes").result(sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    found = nearest_codes(codes, codes.where(F.col("id") % 50 == 0), k=10)
    return found.select(F.col("query_id").alias("query_vec_id"), F.col("rank").alias("place"), F.col("id").alias("vec_id"), "distance")


OP5_SQL = """
WITH d AS (
  SELECT q.vec_id AS query_vec_id, e.vec_id,
    list_sum(list_transform(range(1, greatest(len(q.embedding), len(e.embedding)) + 1), lambda i: CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(e.embedding[i] > 0, false) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_vec_id, row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id)::INTEGER AS place, vec_id, distance
FROM d QUALIFY place <= 10
"""


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_report

    return fingerprint_report(_docs(spark, sf_dir))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), width=4, percent=80)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_report

    return language_report(_docs(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    cut = remove_repeats(_docs(spark, sf_dir), width=400, words=50)
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may fall within a character
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), kept.alias("kept_text"), "n_passage_words", "n_passages")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import importance_resample

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated, good = labels.agg(F.count("quality"), F.sum("quality")).first()  # the share of good rows among the rated is kept
    target = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return importance_resample(_docs(spark, sf_dir), target, keep=(good or 0) / rated if rated else 1.0)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS held, sum(len(ts))::BIGINT AS words FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, t, count(*) AS uses FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(held) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
g AS (SELECT p.r, p.doc_id, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * s.held) // s.words))) AS g FROM p JOIN w USING (t), s),
f AS (SELECT q.item_id, g.r, any_value(g.doc_id) AS doc_id, sum(q.uses * g.g)::BIGINT AS score FROM q JOIN g USING (t) GROUP BY q.item_id, g.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 10
"""


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_report

    return shard_report(_docs(spark, sf_dir), shards=40)


#: CRC-32 byte by byte, the rounds and the walk by recursion.
OP12_SQL = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM d, tab),
n AS (SELECT count(*) AS n, greatest(2, len(ltrim(bin(count(*) - 1), '0'))) AS bits FROM s),
w AS (SELECT n, (bits // 2)::INTEGER AS narrow, (bits - bits // 2)::INTEGER AS wide FROM n),
r AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS number FROM s),
f AS (
  SELECT number, number >> wide AS l, number & ((1::BIGINT << wide) - 1) AS h, narrow AS a, wide AS b, 0 AS i FROM r, w
  UNION ALL
  SELECT number, CASE WHEN i < {ROUNDS} THEN h ELSE l END, CASE WHEN i < {ROUNDS} THEN xor(l, xor(m, m >> 31) & {LOW}) & ((1::BIGINT << a) - 1) ELSE h END, CASE WHEN i < {ROUNDS} THEN b ELSE narrow END, CASE WHEN i < {ROUNDS} THEN a ELSE wide END, CASE WHEN i < {ROUNDS} THEN i + 1 ELSE 0 END
  FROM (SELECT *, (xor(q, q >> 29) & {LOW}) * {SECOND} AS m FROM (SELECT *, xor(h, {round_keys(0)}[i + 1]) * {FIRST} AS q FROM f)), w WHERE i < {ROUNDS} OR ((l << wide) | h) >= n),
p AS (SELECT number, (l << wide) | h AS place FROM f, w WHERE i = {ROUNDS} AND ((l << wide) | h) < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (place % 40)::INTEGER AS shard, place // 40 AS slot, NULL::INTEGER AS grown_shard FROM r JOIN p USING (number)
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0", label=moved)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_mix, op3_token_counts, op4_lines, op5_search, op6_fingerprint, op7_near, op8_language, op9_repeats, op10_quality, op11_ranked, op12_shards, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": OP4_SQL, "op5_search": OP5_SQL, "op11_ranked": OP11_SQL, "op12_shards": OP12_SQL, "op13_negatives": OP13_SQL}
