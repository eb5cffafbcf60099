"""The subpackage's queries: opN_<name>, each over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamark.llm import bpe, chat, jaccard, katz, mixing, neighbours, pii, quality, secrets, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.train_and_score(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_divisible(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_log(chat.as_events(chat.with_probe(table(spark, sf_dir, "conversations")))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ledger in the folder that seamark.secrets.ledger names, a later call scans only what is new; without it, in a ledger of this call."""
    path = spark.conf.get("seamark.secrets.ledger", None)
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.Ledger(spark, path)).drop("blob")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_katz, op2_mixing, op3_jaccard, op4_neighbours, op5_chat, op6_pii, op7_bpe, op8_sharding, op9_quality, op10_secrets)}

#: Sources' shares: water-filling, in the order in which sources reach three times their size.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS ceiling FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(ceiling) OVER before, 0)) / nullif(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0), 0) AS level
  FROM w WINDOW before AS (ORDER BY ceiling / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, CASE WHEN ceiling <= level * weight THEN ceiling ELSE weight * max(CASE WHEN ceiling > level * weight THEN level END) OVER () END AS target FROM l),
b AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
g AS (SELECT k, h, sum(size) AS words FROM d GROUP BY k, h),
r AS (SELECT g.k, h, words, sum(words) OVER (PARTITION BY g.k ORDER BY h) AS upto, target - whole * source_size AS budget FROM g JOIN b USING (k)),
e AS (SELECT k, max(h) AS edge FROM r WHERE upto <= budget OR (upto - words < budget AND upto - budget <= budget - (upto - words)) GROUP BY k)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h <= edge THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b USING (k) LEFT JOIN e USING (k)
"""

OP4_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_neighbours": OP4_SQL}
