"""Calibration of the score-to-probability curve, as aggregates over (score, same) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import log_likelihood

# The grid: theta 0.10 to 0.85 by 0.01, temperature 0.02 to 0.60 by 0.01.
THETAS = range(10, 86)
TEMPERATURES = range(2, 61)
RANGES = 1000  # of probabilities from 0 to 1


def grid_sums(pairs: DataFrame, thetas=THETAS, temperatures=TEMPERATURES, group: str | None = None) -> DataFrame:
    """AGG-17: log likelihood of each (theta, temperature) in hundredths, by group if one is named.

    Equal scores are first counted, so the grid meets distinct values and not all rows; the grid is an array inside the
    row, so nothing is joined."""
    keys = ["s", "same", *([group] if group else [])]
    counted = pairs.select(F.col("score").alias("s"), "same", *([group] if group else [])).groupBy(*keys).agg(F.count("*").alias("n"))
    x = counted.withColumn("theta", F.explode(F.array(*[F.lit(t) for t in thetas]))).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in temperatures])))
    ll = F.col("n") * log_likelihood(F.col("s"), F.col("same"), F.col("theta") / 100.0, F.col("temperature") / 100.0)
    return x.groupBy(*([group] if group else []), "theta", "temperature").agg(F.sum(ll).alias("ll"), F.sum("n").alias("n"))


def best_fit(pairs: DataFrame, thetas=THETAS, temperatures=TEMPERATURES) -> DataFrame:
    """AGG-18: the best grid point; the lower theta, then temperature, of equals."""
    return grid_sums(pairs, thetas, temperatures).orderBy(F.desc("ll"), "theta", "temperature").limit(1)


def leave_one_out(pairs: DataFrame, group: str, thetas=THETAS, temperatures=TEMPERATURES) -> DataFrame:
    """AGG-19: the best grid point without each group: total less the group's own part, so one pass over the pairs."""
    sums = grid_sums(pairs, thetas, temperatures, group)
    rest = F.sum("ll").over(W.partitionBy("theta", "temperature")) - F.col("ll")
    n = F.row_number().over(W.partitionBy(group).orderBy(F.desc("rest"), "theta", "temperature"))
    return sums.withColumn("rest", rest).withColumn("_n", n).where("_n = 1").select(group, "theta", "temperature", F.col("rest").alias("ll"))


def cut_points(rows: DataFrame, targets: tuple[float, ...] = (0.10, 0.05, 0.02)) -> DataFrame:
    """WIN-11: for each target the lowest probability down to which the running error rate meets it (the last such point,
    also behind points that don't), and the share of rows at or above. rows: p, wrong.

    Rows are counted by probability before the running sums, so the rate counts all rows of a value together. The running
    sums are made in ranges of the probability: a range starts from the totals of those above it, of which there are few,
    so no task sees all values."""
    v = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("wrong").cast("int")).alias("w"))
    v = v.withColumn("_r", F.floor(F.col("p") * RANGES).cast("int"))
    totals = v.groupBy("_r").agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"))
    above = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)  # over RANGES + 1 rows at most
    starts = totals.select("_r", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(above), F.lit(0)).alias("_w"), F.sum("_n").over(W.partitionBy()).alias("total"))
    run = W.partitionBy("_r").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    x = v.withColumns({"_cn": F.sum("n").over(run), "_cw": F.sum("w").over(run)}).join(F.broadcast(starts), "_r")
    x = x.select("p", ((F.col("_cw") + F.col("_w")) / (F.col("_cn") + F.col("_n"))).alias("rate"), (F.col("_cn") + F.col("_n")).alias("covered"), "total")
    y = x.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).where("rate <= target")
    return y.groupBy("target").agg(F.min("p").alias("p_best"), (F.max("covered") / F.max("total")).alias("coverage"))


def policy_from_cuts(cuts: DataFrame, new_speaker: float | None = None, stored: float | None = None) -> DataFrame:
    """NUM-09: assign at the 5 % cut, learn at the highest cut that covers a tenth, new speakers from the argument, else
    the stored value, else 0.60."""
    return cuts.agg(F.max(F.when(F.col("target") == 0.05, F.col("p_best"))).alias("assign"), F.max(F.when(F.col("coverage") >= 0.10, F.col("p_best"))).alias("learn"), F.lit(new_speaker if new_speaker is not None else stored if stored is not None else 0.60).alias("new_speaker"))
