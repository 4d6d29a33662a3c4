"""The operators as queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import license_scan, periodic_runs, quality, toxicity
from tidemark.llm.common import folds, table, written
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.inner_products import top_inner_products
from tidemark.llm.lm_score import lm_score
from tidemark.llm.nearest import search
from tidemark.llm.packing import pack
from tidemark.llm.prefix_trie import ids_sha256, members, prefix_trie, turn_paths
from tidemark.llm.sentencepiece_codec import encode_decode
from tidemark.llm.simhash_dedup import simhash_classes
from tidemark.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB has no crc32: a table of one row with each byte's remainder, and the loop over the bytes of an ASCII text `{0}` beside it.
CRC_TABLE = """
crc_step(b, c, k) AS (
    SELECT i, i::UINTEGER, 0 FROM range(256) r(i)
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS remainders FROM crc_step WHERE k = 8)
"""
CRC32 = """
xor(4294967295::UINTEGER, list_reduce(
    list_prepend(4294967295::UINTEGER, list_transform(string_split({0}, ''), lambda x: ascii(x)::UINTEGER)),
    lambda a, x: xor(a >> 8, remainders[(xor(a, x) & 255) + 1])))::BIGINT
"""


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLES["op1_exact_dedup"] = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM n WINDOW same AS (PARTITION BY body)
"""


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@_query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_out=(3, 1))
    scored = toxicity.score(docs, lexicon).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
    return scored.select("doc_id", folds("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_out=(5, 0))
    scored = quality.score(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    return scored.select("doc_id", folds("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


ORACLES["op4_license_scan"] = license_scan.oracle_sql()


@_query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), folds("doc_id", 7, 2))


@_query
def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op13_top_products"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, by crc32 of doc_id, end in copies of one stretch of their words."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (F.lit(1) + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    tail = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periodic_tail(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic_runs.longest())
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Places that share 16 words, paired within a document, and islands of neighbouring pairs of one distance.
ORACLES["op11_periodic_runs"] = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
    SELECT row_number() OVER () AS k, doc_id, {CRC32.format("doc_id::VARCHAR")} AS h,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents, crc_table
), e AS (
    SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), f AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
), v AS (
    SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w
        ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w
    FROM f
), g AS (
    SELECT k, n, i, array_to_string(list_slice(w, i + 1, i + 16), ' ') AS gram FROM (SELECT k, n, w, unnest(range(n - 15)) AS i FROM v)
), pairs AS (
    SELECT x.k, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.k = y.k AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
    SELECT k, q, min(i) AS s, max(i) - min(i) + 16 + q AS len
    FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs) GROUP BY k, q, island
), runs AS (
    SELECT k, s, len, min(q) AS q FROM islands WHERE len >= 24 AND len >= 3 * q GROUP BY k, s, len
), dropped AS (
    SELECT DISTINCT k, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
    SELECT p.k, string_agg(p.word, ' ' ORDER BY p.i) AS words
    FROM (SELECT k, unnest(range(n)) AS i, unnest(w) AS word FROM v) p ANTI JOIN dropped USING (k, i) GROUP BY p.k
), listed AS (
    SELECT k, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY k
), best AS (
    SELECT r.* FROM runs r ANTI JOIN (
        SELECT x.k, x.s, x.len, x.q FROM runs x JOIN runs y ON x.k = y.k
        WHERE y.len * x.q > x.len * y.q OR (y.len * x.q = x.len * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))
    ) worse USING (k, s, len, q)
)
SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, b.len AS length, q AS period, 1000 * b.len // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM v LEFT JOIN listed USING (k) LEFT JOIN kept USING (k) LEFT JOIN best b USING (k)
"""


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): of conversation c up to three first turns, crc32(c) % 4 of them, are replaced with those of c - c % 20."""
    heads = turns.filter(F.col("conv_id") % 20 == 0)
    heads = heads.select(F.col("conv_id").alias("host"), F.slice("turns", F.lit(1), F.lit(3)).alias("head"))
    rows = turns.withColumn("host", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "host", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    head = F.coalesce("head", F.slice("turns", F.lit(1), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turn_paths(table(spark, sf_dir, "conversations")), "turns")
    turns = written(with_shared_heads(turns), "rebuilt-turns")
    nodes, nobody = prefix_trie(turns), F.sha2(F.lit("").cast("binary"), 256)
    ended = nodes.filter("node_key is not null").join(ids_sha256(members(turns)), "node_key").drop("node_key")
    ended = ended.unionByName(nodes.filter("node_key is null").drop("node_key").withColumn("sha256", nobody))
    return ended.drop("n_ends").withColumnRenamed("sha256", "ends_sha256")


ORACLES["op12_prefix_trie"] = f"""
WITH RECURSIVE {CRC_TABLE}, own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
    SELECT *, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table
), r AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(p.t, 1, c.h), []), list_slice(c.t, c.h + 1, len(c.t))) AS t
    FROM h c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
    SELECT conv_id, d, list_slice(t, 1, d) AS p, d = len(t) AS ends FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM r)
), nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d
), kids AS (
    SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL
), weighed AS (
    SELECT p, d, k IS NULL AS leaf,
           CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
    FROM nodes LEFT JOIN kids USING (p)
), under AS (
    SELECT list_slice(p, 1, a) AS p, sum(leaf::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM weighed) GROUP BY list_slice(p, 1, a)
)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k, 0) AS n_children, n_leaves, saved_tokens,
       x.ends_sha256
FROM nodes x JOIN under USING (p) LEFT JOIN kids USING (p)
LEFT JOIN nodes up ON x.d > 0 AND up.p = list_slice(x.p, 1, x.d - 1)
"""
