"""The engine's entities bound to the driver's tables, in Spark and as the SQL of the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as label sequences: a session for each user, a segment for each event, as long as its value says. Times are
    kept in hundredths until the end, so that both engines add whole numbers."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.floor(F.col("value") * 100).cast("bigint")
    x = e.select("user_id", F.row_number().over(w).cast("bigint").alias("pos"), F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type")).alias("speaker"), d.alias("d"), F.sum(d).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("e"))
    return x.select(F.col("user_id").alias("session"), "pos", "speaker", ((F.col("e") - F.col("d")) / 100.0).alias("start"), (F.col("e") / 100.0).alias("end"))


SEG = """seg AS (
  SELECT session, pos, speaker, (e - d) / 100.0::DOUBLE AS "start", e / 100.0::DOUBLE AS "end" FROM (
    SELECT user_id AS session, row_number() OVER w AS pos, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS speaker,
      CAST(floor(value * 100) AS BIGINT) AS d, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcript segments; system speaks as Unknown; a word takes a tenth of a second."""
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("bigint")
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    x = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "Unknown").otherwise(F.col("role")).alias("speaker"), "text", n.alias("n"), F.sum(n).over(w).alias("e"))
    return x.select("session", "pos", "speaker", ((F.col("e") - F.col("n")) / 10.0).alias("start"), (F.col("e") / 10.0).alias("end"), "text")


CONV = """conv AS (
  SELECT session, pos, speaker, (e - n) / 10.0::DOUBLE AS "start", e / 10.0::DOUBLE AS "end", text FROM (
    SELECT conv_id AS session, turn AS pos, CASE WHEN role = 'system' THEN 'Unknown' ELSE role END AS speaker, text,
      len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n,
      CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
    FROM conversations))"""

ISLANDS = """isl AS (
  SELECT session, island, any_value(speaker) AS speaker, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_segments, sum("end" - "start") AS seconds FROM (
    SELECT *, sum(b) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session ORDER BY pos) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM {0})) GROUP BY session, island)"""

NEIGHBOURS = """ro AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session ORDER BY island) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM isl WHERE speaker <> 'Unknown'),
rr AS (SELECT * EXCLUDE (b), sum(b) OVER (PARTITION BY session ORDER BY island ROWS UNBOUNDED PRECEDING) AS run FROM ro),
rl AS (SELECT session, run, any_value(speaker) AS l FROM rr GROUP BY session, run),
nb AS (SELECT session, run, lag(l) OVER w AS pv, lead(l) OVER w AS nx FROM rl WINDOW w AS (PARTITION BY session ORDER BY run)),
isn AS (SELECT rr.*, pv, nx FROM rr JOIN nb USING (session, run))"""
