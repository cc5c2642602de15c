"""The test tables seen as the library's inputs, in Spark and in SQL.

Every SQL fragment below is a common table expression with the same rows as the
property of the same name.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshness.functions.scalars import split_sentences
from freshness.operators.ordered import day_slice, hour_slice, with_row_number, with_running
from freshness.session import stage

RANK = 8  # factors of the stand-in item and user vectors

RATING_ORDER = ["ts", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice", "l_shipdate"]
RATING_ORDER_SQL = ", ".join(RATING_ORDER)


def factor_vector(col: str | Column, multiplier: int) -> Column:
    """Repeatable pseudo-random vector in [-0.5, 0.5) from an integer id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array(
        *[((col * F.lit((2 * i + 1) * multiplier)) % 1000) / F.lit(1000.0) - F.lit(0.5) for i in range(1, RANK + 1)]
    )


def factor_vector_sql(col: str, multiplier: int) -> str:
    parts = [f"(({col} * {(2 * i + 1) * multiplier}) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE" for i in range(1, RANK + 1)]
    return "[" + ", ".join(parts) + "]"


ITEM_MULTIPLIER, USER_MULTIPLIER, FINAL_MULTIPLIER = 7919, 104729, 1299709

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, 1 + (l_quantity - 1) / 49 * 4 AS rating,
         o_orderdate AS ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

VIEWS = """views AS (
  SELECT event_id AS query_id, user_id, ts, value AS y FROM events WHERE event_type = 'view')"""

VERSIONS = """versions AS (
  SELECT event_id AS version_id, user_id, ts, value AS feature FROM events WHERE event_type = 'purchase')"""

ITEMS = f"items AS (SELECT p_partkey AS item_id, {factor_vector_sql('p_partkey', ITEM_MULTIPLIER)} AS item_vec FROM part)"
USERS = f"""users AS (SELECT c_custkey AS user_id, {factor_vector_sql('c_custkey', USER_MULTIPLIER)} AS user_vec,
  {factor_vector_sql('c_custkey', FINAL_MULTIPLIER)} AS final_vec FROM customer)"""

# Two ways to predict a rating: mean of the item, and mean of the user so far.
PREDICTIONS = f"""{RATINGS},
user_so_far AS (
  SELECT *, coalesce(avg(rating) OVER (PARTITION BY user_id ORDER BY {RATING_ORDER_SQL}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3.0) AS so_far,
         avg(rating) OVER (PARTITION BY item_id) AS item_mean
  FROM ratings),
predictions AS (
  SELECT 'item_mean' AS policy, user_id, item_id, ts, l_orderkey, rating AS y_true, item_mean AS y_pred FROM user_so_far
  UNION ALL
  SELECT 'user_mean', user_id, item_id, ts, l_orderkey, rating, so_far FROM user_so_far)"""

# Event-type names stand for policies: one row is one feature update of a key.
UPDATES = """updates AS (
  SELECT event_type AS policy, user_id AS key, ts AS time, event_id AS i FROM events WHERE event_type <> 'view')"""

READINGS = "readings AS (SELECT user_id AS key, ts, event_id, value FROM events)"

ARRIVALS = """arrivals AS (
  SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS step, count(*) AS n, sum(value) AS total
  FROM events GROUP BY 1)"""

# Sentence list of a text: split after '. ' and '.' + newline, separators kept.
SENTENCES_SQL = "string_split(replace(replace({text}, '.' || chr(10), '.' || chr(10) || chr(1)), '. ', '. ' || chr(1)), chr(1))"

DOC_SENTENCES = f"""doc_arrays AS (SELECT doc_id, {SENTENCES_SQL.format(text='text')} AS sents FROM documents),
old_sents AS (
  SELECT doc_id, unnest(sents) AS sentence, unnest(range(len(sents))) AS pos FROM doc_arrays)"""

# New revision: every 7th sentence (from the 4th) dropped, another gets a suffix, one is added.
REVISIONS = f"""{DOC_SENTENCES},
new_raw AS (
  SELECT doc_id, pos, CASE WHEN pos % 7 = 5 THEN sentence || 'Revised. ' ELSE sentence END AS sentence
  FROM old_sents WHERE pos % 7 <> 3
  UNION ALL
  SELECT doc_id, len(sents), 'Added at the end. ' FROM doc_arrays),
new_sents AS (
  SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM new_raw)"""


class Tables:
    """Lazy access to one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def readings(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("key"), "ts", "event_id", "value")

    @cached_property
    def indexed(self) -> DataFrame:
        """Readings with their position per key, written out once for plans that read it several times."""
        return stage(with_row_number(self.readings, "key", ["ts", "event_id"], hour_slice("ts"), "rn"))

    @cached_property
    def views(self) -> DataFrame:
        return self.events.where("event_type = 'view'").select(
            F.col("event_id").alias("query_id"), "user_id", "ts", F.col("value").alias("y")
        )

    @cached_property
    def versions(self) -> DataFrame:
        return self.events.where("event_type = 'purchase'").select(
            F.col("event_id").alias("version_id"), "user_id", "ts", F.col("value").alias("feature")
        )

    @cached_property
    def updates(self) -> DataFrame:
        return self.events.where("event_type <> 'view'").select(
            F.col("event_type").alias("policy"), F.col("user_id").alias("key"), F.col("ts").alias("time"),
            F.col("event_id").alias("i"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.read("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), "l_suppkey", "l_extendedprice",
            "l_shipdate", (F.lit(1) + (F.col("l_quantity") - 1) / 49 * 4).alias("rating"),
        )
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")
        )
        return lines.join(orders, "l_orderkey").select(
            "user_id", "item_id", "rating", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("item_id"), factor_vector("p_partkey", ITEM_MULTIPLIER).alias("item_vec")
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("user_id"), factor_vector("c_custkey", USER_MULTIPLIER).alias("user_vec"),
            factor_vector("c_custkey", FINAL_MULTIPLIER).alias("final_vec"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        rated = stage(self.ratings)  # read three times below; the join is not repeated
        means = rated.groupBy("item_id").agg(F.avg("rating").alias("item_mean"))
        running = with_running(
            rated, "user_id", RATING_ORDER, day_slice("ts"),
            {"_sum": ("sum", F.col("rating")), "_n": ("count", F.col("rating"))},
        )
        so_far = F.coalesce((F.col("_sum") - F.col("rating")) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(3.0))
        both = running.withColumn("user_mean", so_far).join(means, "item_id")
        return both.select(
            "user_id", "item_id", "ts", "l_orderkey", F.col("rating").alias("y_true"),
            F.explode(
                F.array(
                    F.struct(F.lit("item_mean").alias("policy"), F.col("item_mean").alias("y_pred")),
                    F.struct(F.lit("user_mean").alias("policy"), F.col("user_mean").alias("y_pred")),
                )
            ).alias("p"),
        ).select("p.policy", "user_id", "item_id", "ts", "l_orderkey", "y_true", "p.y_pred")

    @cached_property
    def arrivals(self) -> DataFrame:
        start = day_slice(F.lit("2024-01-01").cast("timestamp_ntz")) * 24
        return self.events.groupBy((hour_slice("ts") - start).alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def old_sentences(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(split_sentences("text")).alias("pos", "sentence"))

    @cached_property
    def revisions(self) -> DataFrame:
        """One row per document: old and new sentence lists."""
        old = self.documents.select("doc_id", split_sentences("text").alias("old"))
        indexed = F.transform("old", lambda s, i: F.when(i % 7 == 5, F.concat(s, F.lit("Revised. "))).otherwise(s))
        kept = F.filter(indexed, lambda s, i: i % 7 != 3)
        return old.withColumn("new", F.concat(kept, F.array(F.lit("Added at the end. "))))

    @cached_property
    def new_sentences(self) -> DataFrame:
        return self.revisions.select("doc_id", F.posexplode("new").alias("pos", "sentence"))
