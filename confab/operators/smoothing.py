"""Sequential label smoothing, where earlier rewrites are seen by later ones, as window queries.

A rewrite depends on the label before, which may itself be rewritten. What a place makes of that label is one of few
functions of it, so a running count replaces the loop: one sort of each session, no arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .segments import duration


def smooth(segments: DataFrame, mode: str = "live", short: float = 1.0, session: str = "session") -> DataFrame:
    """WIN-07 (live) and WIN-08 (eval): session, pos, speaker after one pass.

    live: an inner segment under `short` seconds between two of one other label takes it. eval: one that differs from
    both takes the longer neighbour's label, the previous one's if they are equally long. The label before is the
    rewritten one, the label behind the given one."""
    if mode not in ("live", "eval"):
        raise ValueError("mode is live or eval")
    w = W.partitionBy(session).orderBy("pos")
    d = duration(F.col("start"), F.col("end"))
    x = segments.select(session, "pos", "speaker", d.alias("_d"))
    x = x.withColumns({"_p": F.lag("speaker").over(w), "_q": F.lead("speaker").over(w), "_pd": F.lag("_d").over(w), "_qd": F.lead("_d").over(w), "_n": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)})
    inner = (F.col("_n") > 1) & F.col("_next").isNotNull() & (F.col("_d") < short)
    return (_live if mode == "live" else _eval)(x, inner, session).select(session, "pos", "speaker")


def _live(x: DataFrame, inner, session: str) -> DataFrame:
    """A rewritten segment takes the label behind it, so the one behind keeps its own: of places in a row that could be
    rewritten by their given neighbours, every second one is."""
    w = W.partitionBy(session).orderBy("pos")
    x = x.withColumn("_c", F.coalesce(inner & (F.col("_p") == F.col("_q")) & (F.col("speaker") != F.col("_p")), F.lit(False)))
    x = x.withColumn("_last", F.coalesce(F.max(F.when(~F.col("_c"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return x.withColumn("speaker", F.when(F.col("_c") & ((F.col("_n") - F.col("_last")) % 2 == 1), F.col("_p")).otherwise(F.col("speaker")))


def _eval(x: DataFrame, inner, session: str) -> DataFrame:
    """A place keeps its label (fixed), or takes that before whatever it is (copy), or, where the label behind is that of
    the longer neighbour, keeps its own if it equals the label before and else takes that behind (test).

    The label before a test is that of the last place j that isn't a copy: its own or the one behind it. So whether a test
    keeps its label is a function of whether j did: always the same, as j, or not as j. Counting the last kind since the
    last place that is always the same settles all of them."""
    w = W.partitionBy(session).orderBy("pos")
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    differs = F.coalesce(inner & (F.col("speaker") != F.col("_q")), F.lit(False))
    behind = F.col("_qd") > F.col("_pd")
    x = x.withColumn("_kind", F.when(~differs, "fixed").when(behind, "test").otherwise("copy"))
    j = F.last(F.when(F.col("_kind") != "copy", F.struct("speaker", "_q", "_kind")), ignorenulls=True).over(before)
    x = x.withColumn("_j", j)
    kept = F.col("_j.speaker").eqNullSafe(F.col("speaker"))  # if j kept its label, this place does
    moved = F.when(F.col("_j._kind") == "test", F.col("_j._q").eqNullSafe(F.col("speaker"))).otherwise(kept)  # if j didn't
    x = x.withColumns({"_kept": kept, "_moved": moved})
    same = (F.col("_kind") == "fixed") | ((F.col("_kind") == "test") & (F.col("_kept") == F.col("_moved")))
    value = F.when(F.col("_kind") == "fixed", F.lit(True)).otherwise(F.col("_kept"))
    turned = (F.col("_kind") == "test") & ~F.col("_kept") & F.col("_moved")
    x = x.withColumns({"_set": F.when(same, F.struct(F.col("_n").alias("n"), value.alias("v"))), "_turned": F.sum(turned.cast("int")).over(so_far)})
    x = x.withColumn("_from", F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set.v").alias("v"), F.col("_turned").alias("t"))), ignorenulls=True).over(so_far))
    keeps = F.col("_from.v") == ((F.col("_turned") - F.col("_from.t")) % 2 == 0)
    x = x.withColumn("_own", F.when(F.col("_kind") != "copy", F.struct(F.when((F.col("_kind") == "fixed") | keeps, F.col("speaker")).otherwise(F.col("_q")).alias("l"))))
    return x.withColumn("speaker", F.last("_own", ignorenulls=True).over(so_far)["l"])
