"""Interval, nearest and positional joins.

Interval joins meet in time buckets of their key (chunk, session or file): an interval lies in the buckets it touches, a
point in one, so a word meets the turns about it and not all turns of its session, and a long session spreads over tasks.
Ties go to the first in list order, which the pos columns carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds of a bucket: about a turn's length. It changes cost, not results.
BUCKET = 30.0


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("bigint")


def _buckets(start: Column, end: Column, width: float) -> Column:
    """The buckets that [start, end] touches; none for an interval without start or end."""
    return F.when(start <= end, F.sequence(_bucket(start, width), _bucket(end, width)))


def _turn_lists(turns: DataFrame, key: str, width: float) -> DataFrame:
    """key, _b, _turns: the turns that touch each bucket, by pos. Turns within a bucket are few where speech is."""
    t = F.struct("pos", "start", "end", "speaker")
    at = turns.select(key, F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("_b"), t.alias("_t"))
    return at.groupBy(key, "_b").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))


def point_in_interval(words: DataFrame, turns: DataFrame, key: str, bucket: float = BUCKET) -> DataFrame:
    """JOI-01: words (key, pos, start, end) with the speaker of the first turn (key, pos, start, end, speaker) that covers
    their middle, ends included; else of the turn with the least gap (the first of equals); Unknown without turns.

    A word looks up its bucket: the turns that touch it, the last end in earlier buckets and the first start in later ones.
    The latter two are running values over the buckets that words or turns are in, not over words. Words keep all their
    columns and repeat as given; one without start or end is Unknown."""
    names = words.columns
    x = words.withColumn("_t", (F.col("start") + F.col("end")) / 2).withColumn("_b", _bucket(F.col("_t"), bucket))
    asked = x.where("_b is not null").select(key, "_b").distinct()
    cells = asked.join(_turn_lists(turns, key, bucket), [key, "_b"], "full_outer")
    last = F.array_max(F.transform("_turns", lambda t: F.struct(t["end"].alias("e"), (-t["pos"]).alias("p"), t["start"].alias("a"), t["speaker"].alias("s"))))
    first = F.array_min(F.transform("_turns", lambda t: F.struct(t["start"].alias("e"), t["pos"].alias("p"), t["end"].alias("a"), t["speaker"].alias("s"))))
    # both ways from the front: a frame that runs to the end would be gone through again for each row
    forth = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"_l": last, "_f": first})
    cells = cells.withColumn("_l", F.max("_l").over(forth)).withColumn("_f", F.min("_f").over(back))
    turn = lambda p, a, e, s: F.struct(p.alias("pos"), a.alias("start"), e.alias("end"), s.alias("speaker"))
    sides = F.array(F.when(F.col("_l").isNotNull(), turn(-F.col("_l.p"), F.col("_l.a"), F.col("_l.e"), F.col("_l.s"))), F.when(F.col("_f").isNotNull(), turn(F.col("_f.p"), F.col("_f.e"), F.col("_f.a"), F.col("_f.s"))))
    cells = cells.select(key, "_b", F.array_compact(F.concat(F.coalesce("_turns", F.array().cast(dict(cells.dtypes)["_turns"])), sides)).alias("_near"))
    gap = lambda t: F.greatest(t["start"] - F.col("_t"), F.col("_t") - t["end"], F.lit(0.0))
    best = F.array_min(F.transform("_near", lambda t: F.struct(gap(t).alias("g"), t["pos"].alias("p"), t["speaker"].alias("s"))))["s"]
    return x.join(cells, [key, "_b"], "left").select(*names, F.coalesce(best, F.lit("Unknown")).alias("speaker"))


def max_overlap(segments: DataFrame, turns: DataFrame, key: str, bucket: float = BUCKET) -> DataFrame:
    """JOI-02: segments with the speaker of the single turn that overlaps them most (the first of equals); Unknown if none
    does.

    A segment within one bucket looks up that bucket's turns; one over several takes the best of them. Segments keep all
    their columns and repeat as given."""
    names = segments.columns
    lists = _turn_lists(turns, key, bucket)
    start, end = F.col("start"), F.col("end")
    over = lambda t: F.least(end, t["end"]) - F.greatest(start, t["start"])
    best = F.array_min(F.transform(F.filter("_turns", lambda t: over(t) > 0), lambda t: F.struct((-over(t)).alias("o"), t["pos"].alias("p"), t["speaker"].alias("s"))))
    one = F.coalesce(_bucket(start, bucket) >= _bucket(end, bucket), F.lit(True))
    x = segments.withColumn("_b", _bucket(start, bucket))
    near = x.where(one).join(lists, [key, "_b"], "left").select(*names, F.coalesce(best["s"], F.lit("Unknown")).alias("speaker"))
    # long segments: each distinct (key, start, end) once
    wide = segments.where(~one)
    spans = wide.select(key, "start", "end").distinct().withColumn("_b", F.explode(_buckets(start, end, bucket)))
    met = spans.join(lists, [key, "_b"]).select(key, "start", "end", best.alias("_m")).groupBy(key, "start", "end").agg(F.min("_m").alias("_m"))
    far = wide.join(met, [key, "start", "end"], "left").select(*names, F.coalesce("_m.s", F.lit("Unknown")).alias("speaker"))
    return near.union(far)


def summed_overlap(spans: DataFrame, reference: DataFrame, key: str, decision: str = "decision", bucket: float = BUCKET) -> DataFrame:
    """JOI-03: for each decision (its spans: key, decision, start, end) the reference speaker with the most overlap in
    all, and the seconds; null and 0 if there is none. Ties go to the speaker met first by start.

    A span and a turn meet in the first bucket that both touch. Both sides are dealt out by bucket: sizes are estimated before
    rows are exploded, so spans made of a small table would be taken for small and sent whole through the driver."""
    first = lambda c: _bucket(F.col(c), bucket)
    r = reference.select(key, F.col("start").alias("_rs"), F.col("end").alias("_re"), F.col("speaker").alias("reference"), F.explode(_buckets(F.col("start"), F.col("end"), bucket)).alias("_b"))
    s = spans.select(key, decision, "start", "end", F.explode(_buckets(F.col("start"), F.col("end"), bucket)).alias("_b"))
    over = F.least("end", "_re") - F.greatest("start", "_rs")
    hits = s.join(r.hint("merge"), [key, "_b"]).where(F.col("_b") == F.greatest(first("start"), first("_rs"))).withColumn("_o", over).where("_o > 0")
    sums = hits.groupBy(key, decision, "reference").agg(F.sum("_o").alias("seconds"), F.min("_rs").alias("_first"))
    best = sums.groupBy(key, decision).agg(F.min(F.struct((-F.col("seconds")).alias("a"), F.col("_first"), "reference", "seconds")).alias("b"))
    return spans.select(key, decision).distinct().join(best, [key, decision], "left").select(key, decision, "b.reference", F.coalesce("b.seconds", F.lit(0.0)).alias("seconds"))


def nearest(probes: DataFrame, survivors: DataFrame, key: str, at: str = "at", value: str = "label", tie: str = "pos") -> DataFrame:
    """JOI-04: probes (key, tie, at) with the value of the nearest survivor (key, at, value), before or after; the one
    before wins ties; null without survivors.

    Both lie on one line per key: a running last and a reverse running first carry the neighbours, so the cost is one
    sort and not a join of all with all."""
    s = survivors.select(key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col(value).cast("string").alias("_v"), F.lit(None).cast(dict(probes.dtypes)[tie]).alias("_id"))
    p = probes.select(key, F.col(at).alias("_at"), F.lit(-1).alias("_kind"), F.lit(None).cast("string").alias("_v"), F.col(tie).alias("_id"))
    order = ("_at", "_kind", "_v", "_id")
    # both ways from the front: a frame that runs to the end would be gone through again for each row
    forth = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    seen = F.when(F.col("_kind") == 0, F.struct("_at", "_v"))
    x = s.union(p).withColumn("_b", F.last(seen, ignorenulls=True).over(forth)).withColumn("_a", F.last(seen, ignorenulls=True).over(back))
    after = F.col("_b").isNull() | (F.col("_a").isNotNull() & ((F.col("_a._at") - F.col("_at")) < (F.col("_at") - F.col("_b._at"))))
    return x.where("_kind = -1").select(key, F.col("_id").alias(tie), F.col("_at").alias(at), F.when(after, F.col("_a._v")).otherwise(F.col("_b._v")).alias(value))


def merge_tiny_speakers(segments: DataFrame, min_seconds: float, session: str = "session") -> DataFrame:
    """JOI-04, AGG-04, SET-02: segments of speakers with under min_seconds in all take the label of the nearest segment,
    by middle, of a speaker with more; as they are where there is none."""
    total = F.sum(F.col("end") - F.col("start")).over(W.partitionBy(session, "speaker"))
    x = segments.withColumn("_tiny", total < min_seconds).withColumn("at", (F.col("start") + F.col("end")) / 2)
    found = nearest(x.where("_tiny"), x.where("not _tiny").withColumnRenamed("speaker", "label"), session)
    out = x.join(found.select(session, "pos", F.col("label").alias("_to")), [session, "pos"], "left")
    return out.withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to", "_tiny", "at")


def tolerance_nearest(probes: DataFrame, rows: DataFrame, key: str, at: str, other_at: str, tolerance: float, order: str) -> DataFrame:
    """JOI-05: the row of the same key whose time is nearest and strictly within the tolerance; the first by order of
    equals; null if none.

    Times are dealt to buckets as wide as the tolerance; each bucket's rows are one list, and a probe looks up the lists of
    three buckets, so nothing is grouped by probe: probes keep all their columns (nulls too) and repeat as given. Probes
    are read once."""
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("bigint")
    others = [c for c in rows.columns if c != key]
    item = F.struct(F.col(other_at).alias("_u"), F.col(order).alias("_o"), F.struct(*others).alias("_m"))
    # a row lies in its own bucket's list and in its neighbours', so a probe needs one look-up
    lists = rows.select(F.col(key).alias("_key"), F.explode(F.array(*[bucket(other_at) + d for d in (-1, 0, 1)])).alias("_k"), item.alias("_i")).groupBy("_key", "_k").agg(F.collect_list("_i").alias("_l"))
    x = probes.join(lists, (probes[key] == lists["_key"]) & (bucket(at) == lists["_k"]), "left")
    near = F.filter("_l", lambda i: F.abs(F.col(at) - i["_u"]) < tolerance)
    best = F.array_min(F.transform(near, lambda i: F.struct(F.abs(F.col(at) - i["_u"]).alias("d"), i["_o"].alias("o"), i["_m"].alias("m"))))
    return x.withColumn("_best", best).select(*probes.columns, *[F.col(f"_best.m.{c}").alias(c) for c in others])


def positional_zip(a: DataFrame, b: DataFrame, pos: str = "pos", limit: int | None = None) -> DataFrame:
    """JOI-06: row i with row i, to the shorter."""
    x = a.join(b, pos)
    return x if limit is None else x.where(F.col(pos) < limit)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], value: str, missing: str = "Unknown", only_known: list[str] | None = None) -> DataFrame:
    """JOI-11 and JOI-15: the table's value, else `missing`; with only_known, rows of groups without any entry go."""
    x = rows.join(table, keys, "left")
    if only_known:
        x = x.join(table.select(*only_known).distinct(), only_known, "left_semi")
    return x.withColumn(value, F.coalesce(value, F.lit(missing)))


def score_rows(reference: DataFrame, hypothesis: DataFrame, diarization: DataFrame, key: str) -> DataFrame:
    """JOI-12: inner on the transcripts, the diarisation score where there is one."""
    return reference.join(hypothesis, key).join(diarization, key, "left")


def misses(asked: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-14."""
    return asked.join(cache, keys, "left_anti")


def label_profiles(decisions: DataFrame, mapping: DataFrame, key: list[str], scores: str = "raw_scores") -> DataFrame:
    """JOI-16: a row for each scored profile of a decision, with whether it is the reference speaker; a profile without a
    mapping isn't (False and not null)."""
    x = decisions.select(*key, "reference", F.explode(scores).alias("label", "score")).join(mapping, "label", "left")
    return x.withColumn("same", F.col("mapped").eqNullSafe(F.col("reference")) & F.col("reference").isNotNull())


def pad_pairs(reference: DataFrame, hypothesis: DataFrame, key: str) -> DataFrame:
    """SET-04: reference and hypothesis speakers by place, the shorter side filled with null."""
    number = lambda df, out: df.select(key, F.col("speaker").alias(out), F.row_number().over(W.partitionBy(key).orderBy("speaker")).alias("n"))
    return number(reference, "ref_speaker").join(number(hypothesis, "hyp_speaker"), [key, "n"], "full_outer")


def chip_diff(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """SET-03: labels to add, to keep and to take away."""
    x = wanted.distinct().withColumn("_w", F.lit(True)).join(shown.distinct().withColumn("_s", F.lit(True)), "label", "full_outer")
    return x.select("label", F.when(F.col("_w") & F.col("_s"), "keep").when(F.col("_w"), "add").otherwise("remove").alias("action"))


def covers(start: Column, end: Column, t: Column) -> Column:
    return (start <= t) & (t <= end)
