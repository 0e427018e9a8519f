"""Late results and retractions as keyed upserts: sinks take changes with a revision, readers fold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.islands import Rules, refine, touched

# Fixed values of the event type.
FINAL, PARTIAL, SPEAKER_UPDATE, REFINED = "final", "partial", "speaker_update", "refined"


def coalesce_tasks(tasks: DataFrame, by: list[str]) -> DataFrame:
    """STM-05: all finals, and of partials the newest of each key that no final follows. Rows: by, seq, type."""
    w = W.partitionBy(*by)
    last_final = F.max(F.when(F.col("type") == FINAL, F.col("seq"))).over(w)
    last = F.max(F.when(F.col("type") == PARTIAL, F.col("seq"))).over(w)
    x = tasks.withColumns({"_f": last_final, "_p": last})
    return x.where((F.col("type") == FINAL) | ((F.col("seq") == F.col("_p")) & (F.col("_f").isNull() | (F.col("seq") > F.col("_f"))))).drop("_f", "_p")


def latest(rows: DataFrame, by: list[str], revision: str) -> DataFrame:
    """STM-06 and STM-11: of each key the row with the highest revision. A map-side aggregate and no window."""
    rest = [c for c in rows.columns if c not in by]
    x = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), revision).alias("_r"))
    return x.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def transcript_view(events: DataFrame, session: str = "session") -> DataFrame:
    """STM-08 and STM-09: session, segment_index, text as a reader sees them after all events (type, seq, provisional).

    A speaker update counts only if its place exists by then: some final at this index or above came before. A provisional
    final after a counted update is dropped; of the rest the last one wins. Places below the highest without a text
    are empty."""
    w = W.partitionBy(session).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    mine = W.partitionBy(session, "segment_index").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    final = F.col("type") == FINAL
    # a final that is dropped was given a place before, so it can't raise the top
    x = events.where(final | (F.col("type") == SPEAKER_UPDATE)).withColumn("_top", F.max(F.when(final, F.col("segment_index"))).over(w))
    x = x.withColumn("_ok", final | F.coalesce(F.col("segment_index") <= F.col("_top"), F.lit(False)))
    x = x.withColumn("_done", F.coalesce(F.max(F.when(~final & F.col("_ok"), F.lit(1))).over(mine), F.lit(0)))
    kept = x.where("_ok").where(~(final & F.coalesce("provisional", F.lit(False)) & (F.col("_done") == 1)))
    texts = kept.groupBy(session, "segment_index").agg(F.max_by("text", "seq").alias("text"))
    tops = events.where(final).groupBy(session).agg(F.max("segment_index").alias("_top"))
    places = tops.select(session, F.explode(F.sequence(F.lit(0).cast(dict(events.dtypes)["segment_index"]), F.col("_top"))).alias("segment_index"))
    return places.join(texts, [session, "segment_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def refine_session(upserts: DataFrame, rules: Rules = Rules(), session: str = "session") -> DataFrame:
    """STM-11: folds a session's upserts (session, segment_index, revision, pos in the chunk, speaker, start, end, text) to
    their last revision, refines the whole and gives the segments of the chunks that changed."""
    top = F.max("revision").over(W.partitionBy(session, "segment_index"))
    now = upserts.withColumn("_top", top).where("revision = _top").drop("_top")
    whole = now.withColumnRenamed("pos", "chunk_pos").withColumn("pos", F.row_number().over(W.partitionBy(session).orderBy("segment_index", "chunk_pos")))
    return touched(refine(whole, rules, session), [session, "segment_index"])
