"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, html, language, lm, mixing, pieces, pivots, quality, secrets, simhash


#: A public SentencePiece model, at this path on every machine.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int) -> Column:
    """Of the CRC-32 of a document's id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(7) == 2
    found = lm.scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_elsewhere", "elsewhere")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(3) == 1
    network = language.learn(docs.filter(~held_out))
    return language.identify(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, pivots.scaled_floor(64.0))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_lm, op3_html, op4_language, op5_forest, op6_pivots, op7_mixing, op8_secrets, op9_pieces, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op6_pivots": OP6_SQL, "op7_mixing": OP7_SQL}


OP6_SQL = r"""
WITH l AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT len(e) AS n FROM l GROUP BY ALL ORDER BY count(*) DESC, n LIMIT 1),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(x::DOUBLE * 64)) AS f FROM l WHERE len(e) = (SELECT n FROM u)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.f, c.f)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM w),
t AS (SELECT source, source_size, rank, least(cap, (SELECT max(step) FROM l) * weight) AS target FROM l),
u AS (SELECT t.rank, t.source_size, t.target, d.doc_id, d.size, sum(d.size)::BIGINT AS words, md5(coalesce(d.doc_id::VARCHAR, '')) AS h
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0 GROUP BY ALL),
q AS (SELECT *, sum(words) OVER (PARTITION BY rank ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served FROM u),
e AS (SELECT *, (served + source_size * turn) / target AS finish FROM q, (VALUES (0), (1)) p(turn)),
r AS (SELECT *, sum(words) OVER (ORDER BY finish, h, doc_id NULLS FIRST, size, rank, turn ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT rank, doc_id, size, count(*) AS repeats FROM r WHERE upto <= 1.5::DOUBLE * (SELECT sum(source_size) FROM s) GROUP BY ALL)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, d.size * coalesce(k.repeats, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.rank = t.rank AND k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.size = d.size
"""
