"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import centroids, decontaminate, divergence, exact_dedup, lm, mixing, quality, repeats, secrets, sharding, simhash, token_prefix, toxicity
from quillmill.llm.common import Stash


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_docs(spark, sf_dir), with_text=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_docs(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_docs(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return token_prefix.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("source")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(sharding.write_shards(_docs(spark, sf_dir), Stash(spark, "op11").root))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": op1_repeats,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_secrets": op5_secrets,
        "op6_lm_scores": op6_lm_scores,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_token_counts": op9_token_counts,
        "op10_mixing": op10_mixing,
        "op11_sharding": op11_sharding,
        "op12_centroids": op12_centroids,
        "op13_divergence": op13_divergence,
    }


#: DuckDB runs its patterns over UTF-8; a run of ASCII white space is the same there.
OP2 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) AS k FROM (SELECT e.vec_id, c.c, sum((e.x - c.x) * (e.x - c.x)) AS distance FROM e JOIN c{r} c ON c.d = e.d GROUP BY e.vec_id, c.c)) WHERE k = 1)"""
_MOVE = """,
s{r} AS (SELECT a.c, e.d, sum(e.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN e ON e.vec_id = a.vec_id GROUP BY a.c, e.d),
c{n} AS MATERIALIZED (SELECT c.c, c.d, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END AS x FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c AND s.d = c.d),"""

#: All nearest centroids by plain distances to each of the 16.
OP12 = (
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS d FROM v),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT f.c, e.d, e.x FROM f JOIN e ON e.vec_id = f.vec_id WHERE f.c < 16),"""
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(3))
    + _ROUND.format(r=3)
    + """,
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT a.vec_id, a.c::INT AS cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256 FROM a3 a JOIN h ON h.c = a.c
"""
)

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total FROM g LEFT JOIN o ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 2))::HUGEINT // (t.total + 2 * v.v)::HUGEINT AS p, 1 + (1000000000 * (k.n + 2))::HUGEINT // (v.total + 2 * v.v)::HUGEINT AS q FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op12_centroids": OP12, "op13_divergence": OP13}
