"""Queries over the driver's tables that use the engine's operators, each with the SQL of its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import num, text, vec
from ..operators import calibration, intervals, islands, metrics, reports, segments, similarity, smoothing, tracking
from ..operators.islands import Rules
from ..streaming import chunking, upserts
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .views import CONV, ISLANDS, NEIGHBOURS, SEG, table
from .views import segments as seg_view
from .views import turns as conv_view

#: Thresholds lie between the hundredths that durations have, so no sum falls on one.
RULES = Rules(small_seconds=60.005, small_segments=3, tiny_seconds=700.005, tiny_segments=12, tiny_min_islands=2, tiny_max_islands=12, tiny_share=0.25, gap_seconds=80.005)


ISL_SEG, ISL_CONV = ISLANDS.format("seg"), ISLANDS.format("conv")


@query(f"WITH {CONV}, {ISL_CONV} SELECT session, CAST(island AS BIGINT) AS island, speaker, first_pos, last_pos, n_segments, round(seconds, 1) AS seconds FROM isl")
def islands_by_session(spark, sf):
    return islands.islands(conv_view(spark, sf)).withColumn("seconds", F.round("seconds", 1))


@query(f"WITH {SEG} SELECT session, speaker, round(sum(\"end\" - \"start\"), 2) AS seconds, count(*) AS n_segments FROM seg GROUP BY ALL")
def speaker_summary(spark, sf):
    return segments.summary(seg_view(spark, sf)).withColumn("seconds", F.round("seconds", 2))


@query(f"WITH {SEG}, {ISL_SEG} SELECT session, speaker, round(sum(seconds), 2) AS seconds, CAST(sum(n_segments) AS BIGINT) AS n_segments, count(*) AS n_islands FROM isl WHERE speaker <> 'Unknown' GROUP BY ALL")
def label_stats(spark, sf):
    return islands.label_stats(islands.islands(seg_view(spark, sf))).withColumn("seconds", F.round("seconds", 2))


@query(f"WITH {SEG}, {ISL_SEG}, {NEIGHBOURS} SELECT session, CAST(island AS BIGINT) AS island, speaker, pv AS prev_label, nx AS next_label FROM isn")
def prev_next_other(spark, sf):
    return islands.neighbours(islands.islands(seg_view(spark, sf))).select("session", "island", "speaker", "prev_label", "next_label")


def _numbered(source: str) -> str:
    return f"""nu AS (SELECT * EXCLUDE (b), sum(b) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session ORDER BY pos) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM {source}))"""


def _rules_sql(r: Rules) -> tuple[str, str, str]:
    """The changes `ch` of the small, the tiny and the gap rule."""
    small = f"""ch AS (SELECT session, island, pv AS t FROM (SELECT *, count(*) OVER (PARTITION BY session, speaker) AS c FROM isn) WHERE c = 1 AND seconds <= {r.small_seconds} AND n_segments <= {r.small_segments} AND pv = nx)"""
    tiny = f"""st AS (SELECT session, speaker FROM isl WHERE speaker <> 'Unknown' GROUP BY ALL HAVING sum(seconds) <= {r.tiny_seconds} AND sum(n_segments) <= {r.tiny_segments} AND count(*) BETWEEN {r.tiny_min_islands} AND {r.tiny_max_islands}),
vo AS (SELECT session, speaker, v, count(*) AS n FROM (SELECT session, speaker, unnest([pv, nx]) AS v FROM isn JOIN st USING (session, speaker)) WHERE v IS NOT NULL GROUP BY ALL),
tp AS (SELECT *, count(*) OVER (PARTITION BY session, speaker) AS many FROM (SELECT *, max(n) OVER (PARTITION BY session, speaker) AS m, sum(n) OVER (PARTITION BY session, speaker) AS al FROM vo) WHERE n = m),
wn AS (SELECT session, speaker, v FROM tp WHERE many = 1 AND n / al >= {r.tiny_share} AND NOT EXISTS (SELECT 1 FROM st WHERE st.session = tp.session AND st.speaker = tp.v)),
ch AS (SELECT session, island, v AS t FROM isl JOIN wn USING (session, speaker))"""
    gap = f"""ch AS (SELECT session, island, p AS t FROM (SELECT *, lag(speaker) OVER w AS p, lead(speaker) OVER w AS q FROM isl WINDOW w AS (PARTITION BY session ORDER BY island)) WHERE speaker = 'Unknown' AND p = q AND p <> 'Unknown' AND n_segments <= {r.gap_segments} AND seconds <= {r.gap_seconds})"""
    return small, tiny, gap


SMALL, TINY, GAP = _rules_sql(RULES)


def _rule_sql(source: str, rule: str, changed: bool = True) -> str:
    """One rule over a relation of segments; changed: only what it relabels."""
    need = NEIGHBOURS + ", " if "isn" in rule else ""
    tail = "SELECT session, pos, t AS speaker FROM nu JOIN ch USING (session, island)" if changed else 'SELECT session, pos, coalesce(t, speaker) AS speaker, "start", "end" FROM nu LEFT JOIN ch USING (session, island)'
    return f"WITH {_numbered(source)}, {ISLANDS.format(source)}, {need}{rule} {tail}"


def _rule(spark, sf, rule) -> DataFrame:
    before = seg_view(spark, sf).withColumn("_b", F.col("speaker"))
    return islands.apply_rule(before, rule, RULES).where("speaker <> _b").select("session", "pos", "speaker")


# All sessions of the driver's tables have at least three events, so the least length doesn't show here; tests hold it.
@query(f"WITH {SEG}, long AS (SELECT * FROM seg QUALIFY count(*) OVER (PARTITION BY session) >= 3) SELECT * FROM ({_rule_sql('long', SMALL)})")
def small_island_merge(spark, sf):
    return _rule(spark, sf, islands.small_changes)


@query(f"WITH {SEG}, long AS (SELECT * FROM seg QUALIFY count(*) OVER (PARTITION BY session) >= 3) SELECT * FROM ({_rule_sql('long', TINY)})")
def tiny_fragment_votes(spark, sf):
    return _rule(spark, sf, islands.tiny_changes)


@query(f"WITH {SEG}, long AS (SELECT * FROM seg QUALIFY count(*) OVER (PARTITION BY session) >= 3) SELECT * FROM ({_rule_sql('long', GAP)})")
def unknown_fill(spark, sf):
    return _rule(spark, sf, islands.gap_changes)


@query(
    f"""WITH {SEG}, p0 AS MATERIALIZED (SELECT * FROM seg QUALIFY count(*) OVER (PARTITION BY session) >= 3),
p1 AS MATERIALIZED ({_rule_sql('p0', SMALL, False)}), p2 AS MATERIALIZED ({_rule_sql('p1', TINY, False)}), p3 AS MATERIALIZED ({_rule_sql('p2', GAP, False)})
SELECT p0.session, p0.pos, p3.speaker, p0.speaker AS refined_from, CASE WHEN p1.speaker <> p0.speaker THEN 'small' WHEN p2.speaker <> p1.speaker THEN 'tiny' ELSE 'gap' END AS refined_by
FROM p0 JOIN p1 USING (session, pos) JOIN p2 USING (session, pos) JOIN p3 USING (session, pos) WHERE p3.speaker <> p0.speaker"""
)
def refine_pass1(spark, sf):
    r = Rules(**{**RULES.__dict__, "passes": 1})
    return islands.refine(seg_view(spark, sf), r).where("refined_from is not null").select("session", "pos", "speaker", "refined_from", "refined_by")


def _passes_sql(source: str, r: Rules) -> str:
    """All rules of all passes as steps p0, p1, ...; a pass that changes nothing is like one that isn't run."""
    names, rules, n = ("small", "tiny", "gap"), _rules_sql(r), 3 * r.passes
    steps = [f"p{k + 1} AS MATERIALIZED ({_rule_sql(f'p{k}', rules[k % 3], False)})" for k in range(n)]
    by = " ".join(f"WHEN p{k + 1}.speaker <> p{k}.speaker THEN '{names[k % 3]}'" for k in range(n))
    joins = " ".join(f"JOIN p{k + 1} USING (session, pos)" for k in range(n))
    last = f"p{n}"
    return f"""p0 AS MATERIALIZED (SELECT session, pos, speaker, "start", "end" FROM {source} QUALIFY count(*) OVER (PARTITION BY session) >= 3), {", ".join(steps)}
SELECT session, pos, {last}.speaker, p0."start", p0."end", CASE WHEN {last}.speaker <> p0.speaker THEN p0.speaker END AS refined_from, CASE {by} END AS refined_by FROM p0 {joins}
UNION ALL SELECT session, pos, speaker, "start", "end", NULL, NULL FROM (SELECT *, count(*) OVER (PARTITION BY session) AS c FROM {source}) WHERE c < 3"""


@query(f"WITH {CONV}, {_passes_sql('conv', RULES)}")
def refine_sessions(spark, sf):
    return islands.refine(conv_view(spark, sf).drop("text"), RULES)


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '\\[[^\\]]*\\]', '', 'g'), '-', ' '), '[^\\p{L}\\p{N}_\\s'']', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM pages")
def clean_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_tagged(F.col("html")).alias("cleaned"))


NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len(list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '')) AS n_words, length(replace({NORM.format('text')}, ' ', '')) AS n_letters FROM documents")
def word_counts(spark, sf):
    n = text.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(text.words(n)).cast("bigint").alias("n_words"), F.size(text.characters(n)).cast("bigint").alias("n_letters"))


LINE = "'[' || speaker || '] ' || printf('%.1f', \"start\") || 's - ' || printf('%.1f', \"end\") || 's: ' || text"


@query(f"WITH {CONV} SELECT session, pos, {LINE} AS line FROM conv")
def format_result_line(spark, sf):
    return conv_view(spark, sf).select("session", "pos", text.format_result_line(F.col("speaker"), F.col("start"), F.col("end"), F.col("text")).alias("line"))


@query(f"""WITH {CONV}, l AS (SELECT session, pos, {LINE.replace('text', "string_split(text, chr(10))[1]")} AS line FROM conv)
SELECT session, pos, regexp_extract(line, '^\\[(.*)\\]\\s+(\\d+(?:\\.\\d+)?)s', 1) AS speaker, CAST(regexp_extract(line, '\\]\\s+(\\d+(?:\\.\\d+)?)s', 1) AS DOUBLE) AS "start",
  CAST(regexp_extract(line, 's\\s*-\\s*(\\d+(?:\\.\\d+)?)s:', 1) AS DOUBLE) AS "end", trim(regexp_extract(line, 's:\\s*(.*)$', 1)) AS text FROM l""")
def parse_result_line(spark, sf):
    c = conv_view(spark, sf)
    line = text.format_result_line(F.col("speaker"), F.col("start"), F.col("end"), F.element_at(F.split("text", "\n"), 1))
    return c.select("session", "pos", text.parse_result_line(line).alias("r")).select("session", "pos", "r.*")


@query("""SELECT doc_id, lower(split_part(l, '-', 1)) AS base, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'es' THEN 'spa_Latn' END AS code, lang IS NOT NULL AND lang <> '' AS same
FROM (SELECT doc_id, lang, upper(lang) || '-X' AS l FROM documents)""")
def base_language(spark, sf):
    long = F.concat(F.upper("lang"), F.lit("-X"))
    return table(spark, sf, "documents").select("doc_id", text.base_language(long).alias("base"), text.language_code(long).alias("code"), text.same_language(long, F.col("lang")).alias("same"))


@query("""SELECT event_id, NOT (compression > 2.4 OR (no_speech > 0.6 AND logprob < -1) OR (t IN ('thank you', 'you', 'bye.') AND (no_speech > 0.3 OR logprob < -0.5))) AS kept FROM (
 SELECT event_id, value / 40 AS compression, (event_id % 100) / 100.0::DOUBLE AS no_speech, -(event_id % 37) / 20.0::DOUBLE AS logprob, ['thank you', 'you', 'bye.', 'a sentence'][CAST(event_id % 4 AS INTEGER) + 1] AS t FROM events)""")
def hallucination_filter(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in ("Thank you", "You", "bye.", "a sentence")]), (F.col("event_id") % 4 + 1).cast("int"))
    bad = segments.is_hallucination(t, F.col("value") / 40, F.col("event_id") % 100 / 100.0, -(F.col("event_id") % 37) / 20.0)
    return table(spark, sf, "events").select("event_id", (~bad).alias("kept"))


@query(f"WITH {SEG} SELECT session, pos, speaker, \"start\", least(\"end\", 1000.0) AS \"end\" FROM seg WHERE \"start\" < 1000 AND least(\"end\", 1000.0) > \"start\"")
def truncate_intervals(spark, sf):
    return segments.truncate(seg_view(spark, sf), 1000.0)


@query(f"WITH {SEG} SELECT session, pos, speaker, greatest(\"start\", 200.0) AS \"start\", least(\"end\", 1500.0) AS \"end\" FROM seg WHERE least(\"end\", 1500.0) > greatest(\"start\", 200.0)")
def clip_intervals(spark, sf):
    return segments.clip(seg_view(spark, sf), 200.0, 1500.0)


def _turns(spark, sf) -> DataFrame:
    """Lineitem as turns of an order: a line takes as many seconds as its quantity, on a clock that restarts each order;
    every other turn leaves a gap behind it."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n, q = F.row_number().over(w), F.sum("l_quantity").over(w.rowsBetween(W.unboundedPreceding, 0))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), n.alias("pos"), F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("speaker"), (q - F.col("l_quantity")).alias("start"), q.alias("q"))
    return li.select("chunk", "pos", "speaker", "start", (F.col("q") - F.col("pos") % 2 * 3).alias("end")).where("end > start")


TURNS = """tn AS (SELECT * FROM (SELECT l_orderkey AS chunk, pos, 'S' || CAST(l_suppkey % 3 AS VARCHAR) AS speaker, q - l_quantity AS "start", q - (pos % 2) * 3 AS "end" FROM (
  SELECT *, row_number() OVER w AS pos, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS q
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))) WHERE "end" > "start")"""
WORDS = """wd AS (SELECT o_orderkey AS chunk, CAST(i AS INTEGER) AS pos, i * 7.0::DOUBLE AS "start", i * 7.0::DOUBLE + 2 AS "end" FROM orders, range(0, 12) t(i))"""


def _words(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos")).withColumn("start", F.col("pos") * 7.0).withColumn("end", F.col("pos") * 7.0 + 2)


@query(f"""WITH {TURNS}, {WORDS}, c AS (SELECT wd.*, tn.speaker, greatest(tn."start" - (wd."start" + wd."end") / 2, (wd."start" + wd."end") / 2 - tn."end", 0) AS g, tn.pos AS tp FROM wd LEFT JOIN tn USING (chunk))
SELECT chunk, pos, "start", "end", coalesce(speaker, 'Unknown') AS speaker FROM c QUALIFY row_number() OVER (PARTITION BY chunk, pos ORDER BY g, tp) = 1""")
def point_in_interval(spark, sf):
    return intervals.point_in_interval(_words(spark, sf), _turns(spark, sf), "chunk")


@query(f"""WITH {TURNS}, {WORDS}, c AS (SELECT wd.*, CASE WHEN least(wd."end", tn."end") > greatest(wd."start", tn."start") THEN speaker END AS s, greatest(least(wd."end", tn."end") - greatest(wd."start", tn."start"), 0) AS o, tn.pos AS tp FROM wd LEFT JOIN tn USING (chunk))
SELECT chunk, pos, "start", "end", coalesce(s, 'Unknown') AS speaker FROM c QUALIFY row_number() OVER (PARTITION BY chunk, pos ORDER BY o DESC NULLS LAST, tp) = 1""")
def max_overlap(spark, sf):
    return intervals.max_overlap(_words(spark, sf), _turns(spark, sf), "chunk")


@query(f"""WITH {TURNS}, {WORDS}, h AS (SELECT chunk, wd.pos // 4 AS decision, speaker, sum(least(wd."end", tn."end") - greatest(wd."start", tn."start")) AS seconds, min(tn."start") AS f
  FROM wd JOIN tn USING (chunk) WHERE least(wd."end", tn."end") > greatest(wd."start", tn."start") GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY chunk, decision ORDER BY seconds DESC, f, speaker) = 1)
SELECT d.chunk, CAST(d.decision AS INTEGER) AS decision, b.speaker AS reference, coalesce(b.seconds, 0) AS seconds FROM (SELECT DISTINCT chunk, pos // 4 AS decision FROM wd) d LEFT JOIN b USING (chunk, decision)""")
def summed_overlap(spark, sf):
    spans = _words(spark, sf).withColumn("decision", F.floor(F.col("pos") / 4).cast("int"))
    return intervals.summed_overlap(spans, _turns(spark, sf), "chunk")


@query(f"""WITH {SEG}, t AS (SELECT *, sum("end" - "start") OVER (PARTITION BY session, speaker) < 700.005 AS tiny, ("start" + "end") / 2 AS at FROM seg),
c AS (SELECT p.session, p.pos, s.speaker, row_number() OVER (PARTITION BY p.session, p.pos ORDER BY abs(s.at - p.at), CASE WHEN s.at < p.at THEN 0 ELSE 1 END, s.speaker) AS n FROM t p JOIN t s USING (session) WHERE p.tiny AND NOT s.tiny)
SELECT t.session, t.pos, coalesce(c.speaker, t.speaker) AS speaker FROM t LEFT JOIN c ON t.session = c.session AND t.pos = c.pos AND c.n = 1 AND t.tiny""")
def nearest_survivor(spark, sf):
    return intervals.merge_tiny_speakers(seg_view(spark, sf), 700.005).select("session", "pos", "speaker")


@query("""WITH p AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS click_id, CAST(epoch(ts) AS BIGINT) AS u FROM events WHERE event_type = 'click')
SELECT p.user_id, p.event_id, coalesce(b.click_id, -1) AS click_id FROM p LEFT JOIN (SELECT p.event_id, c.click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(t - u), click_id) AS n FROM p JOIN c USING (user_id) WHERE abs(t - u) < 21600) b ON p.event_id = b.event_id AND b.n = 1""")
def tolerance_nearest(spark, sf):
    # whole seconds, rounded as the oracle's cast does
    e = table(spark, sf, "events").withColumn("s", F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint"))
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("s").alias("t"))
    c = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("u"))
    return intervals.tolerance_nearest(p, c, "user_id", "t", "u", 21600, "click_id").select("user_id", "event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


@query("SELECT b.item_id AS pos, b.text AS source, d.text AS reference FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def positional_zip(spark, sf):
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("source"))
    return intervals.positional_zip(a, table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("reference")))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _profiles(spark, sf) -> DataFrame:
    """The first ten vectors stand for speakers; their number is fixed."""
    return table(spark, sf, "embeddings").where("vec_id < 10").select(F.format_string("SPEAKER_%02d", "vec_id").alias("label"), F.col("embedding").alias("centroid"))


PROFILE_SCORES = f"""{VEC}, sc AS (SELECT a.vec_id AS probe, printf('SPEAKER_%02d', b.vec_id) AS label, {COS.format('a.e', 'b.e')} AS score FROM v a, v b WHERE b.vec_id < 10 AND a.vec_id >= 10)"""


def _scores(spark, sf) -> DataFrame:
    """JOI-09: every probe against every profile. The profiles (ten rows) are an array in each row, so nothing is joined."""
    p = _profiles(spark, sf).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("profiles"))
    e = table(spark, sf, "embeddings").where("vec_id >= 10").withColumn("_one", F.lit(1))
    x = e.join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one").select(F.col("vec_id").alias("probe"), "embedding", F.explode("profiles").alias("p"))
    return x.select("probe", "p.label", vec.cosine(F.col("embedding"), F.col("p.centroid")).alias("score"))


@query(f"WITH {PROFILE_SCORES}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS s2 FROM sc WINDOW w AS (PARTITION BY probe ORDER BY score DESC, label)) SELECT probe, label AS best, round(score, 6) AS best_score, round(score - s2, 6) AS margin FROM r WHERE n = 1")
def profile_top1_margin(spark, sf):
    return reports.top_margin(_scores(spark, sf)).select("probe", "best", F.round("best_score", 6).alias("best_score"), F.round("margin", 6).alias("margin"))


POST = f"""{PROFILE_SCORES}, t AS (SELECT *, count(*) OVER w AS k, max(score) OVER w AS top FROM sc WINDOW w AS (PARTITION BY probe)),
z AS (SELECT *, (score - 0.1) / 0.09 AS z, (0.1 - top) / 0.09 AS u FROM t), e AS (SELECT *, u + 0.25 * ln(k) AS v FROM z),
p AS (SELECT probe, label, exp(z) / (sum(exp(z)) OVER w + exp(v)) AS p, exp(v) / (sum(exp(z)) OVER w + exp(v)) AS p_unknown, exp(u) / (sum(exp(z)) OVER w + exp(u)) AS p_unknown_raw FROM e WINDOW w AS (PARTITION BY probe))"""


def _posterior(spark, sf) -> DataFrame:
    return num.posterior(_scores(spark, sf), num.PosteriorConfig(theta=0.1, temperature=0.09))


@query(f"WITH {POST} SELECT probe, label, round(p, 6) AS p, round(p_unknown, 6) AS p_unknown, round(p_unknown_raw, 6) AS p_unknown_raw FROM p")
def posterior(spark, sf):
    return _posterior(spark, sf).select("probe", "label", *[F.round(c, 6).alias(c) for c in ("p", "p_unknown", "p_unknown_raw")])


@query(f"WITH {POST} SELECT probe, max(p) >= 0.459 AS confident, max(p) >= 0.6 AS may_learn, any_value(p_unknown_raw) >= 0.3 AS may_create FROM p GROUP BY probe")
def policy_gates(spark, sf):
    one = _posterior(spark, sf).groupBy("probe").agg(F.max("p").alias("p"), F.first("p_unknown_raw").alias("u"))
    return one.select("probe", num.policy_gates(F.col("p"), F.col("u"), 0.459, 0.6, 0.3).alias("g")).select("probe", "g.*")


@query(f"WITH {PROFILE_SCORES} SELECT probe, label, round(score - 0.5 * ((sum(score) OVER w - score) / (count(*) OVER w - 1) - 0.05), 6) AS normalized FROM sc WINDOW w AS (PARTITION BY probe)")
def cohort_norm(spark, sf):
    return num.cohort_normalize(_scores(spark, sf), 0.5, 0.05).select("probe", "label", F.round("normalized", 6).alias("normalized"))


@query(f"WITH {VEC} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.3")
def cosine_pairs(spark, sf):
    """JOI-10, VEC-04: pairs of one label alike."""
    found = similarity.similar_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return found.select("a_id", "b_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {VEC}, c AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM c) SELECT label, CAST(i AS INTEGER) AS dim, round(x, 6) AS x FROM n")
def centroids(spark, sf):
    """AGG-20: the normalised mean vector of each label."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("label")))
    return m.select("label", (F.col("i") + 1).alias("dim"), F.round(F.col("m") / n, 6).alias("x"))


def _pairs(spark, sf) -> DataFrame:
    """Labelled scores: longer documents score higher."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    x = table(spark, sf, "labels").join(d, "doc_id")
    return x.select("source", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"), (F.col("quality") == 1).alias("same"))


PAIRS = "pr AS (SELECT source, n_chars / (n_chars + 2000.0::DOUBLE) AS score, quality = 1 AS same FROM labels JOIN documents USING (doc_id))"
GRID = """g AS (SELECT CAST(t AS INTEGER) AS theta, CAST(u AS INTEGER) AS temperature FROM range(10, 86) a(t), range(2, 61) b(u)),
q AS (SELECT source, theta, temperature, same, 1 / (1 + exp(-greatest(-40, least(40, (score - theta / 100.0::DOUBLE) / (temperature / 100.0::DOUBLE))))) AS p FROM pr, g),
l AS (SELECT source, theta, temperature, sum(ln(greatest(1e-9, least(1 - 1e-9, CASE WHEN same THEN p ELSE 1 - p END)))) AS ll, count(*) AS n FROM q GROUP BY ALL)"""


@query(f"WITH {PAIRS}, {GRID} SELECT theta, temperature, round(sum(ll), 4) AS ll, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL")
def loglik_grid(spark, sf):
    return calibration.grid_sums(_pairs(spark, sf)).withColumn("ll", F.round("ll", 4))


@query(f"WITH {PAIRS}, {GRID}, s AS (SELECT theta, temperature, sum(ll) AS ll FROM l GROUP BY ALL) SELECT theta, temperature, round(ll, 4) AS ll FROM s ORDER BY s.ll DESC, theta, temperature LIMIT 1")
def best_fit(spark, sf):
    return calibration.best_fit(_pairs(spark, sf)).select("theta", "temperature", F.round("ll", 4).alias("ll"))


@query(f"WITH {PAIRS}, {GRID}, r AS (SELECT source, theta, temperature, sum(ll) OVER (PARTITION BY theta, temperature) - ll AS rest FROM l) SELECT source, theta, temperature, round(rest, 4) AS ll FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY rest DESC, theta, temperature) = 1")
def loo_refit(spark, sf):
    return calibration.leave_one_out(_pairs(spark, sf), "source").withColumn("ll", F.round("ll", 4))


@query(f"WITH {PAIRS}, v AS (SELECT score AS p, count(*) AS n, sum(CAST(NOT same AS INTEGER)) AS w FROM pr GROUP BY ALL), x AS (SELECT p, sum(w) OVER o / sum(n) OVER o AS rate, sum(n) OVER o AS c, sum(n) OVER () AS t FROM v WINDOW o AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT target, min(p) AS p_best, round(max(c) / max(t), 6) AS coverage FROM x, (SELECT unnest([0.3, 0.2, 0.15]::DOUBLE[]) AS target) WHERE rate <= target GROUP BY target")
def cutpoints(spark, sf):
    rows = _pairs(spark, sf).select(F.col("score").alias("p"), (~F.col("same")).alias("wrong"))
    return calibration.cut_points(rows, (0.3, 0.2, 0.15)).withColumn("coverage", F.round("coverage", 6))


def _texts(spark, sf) -> DataFrame:
    """Pairs of texts: consecutive benchmark items."""
    b = table(spark, sf, "benchmark")
    a = b.select("item_id", F.col("text").alias("reference"))
    return a.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis")), "item_id")


TEXTS = "tx AS (SELECT a.item_id, a.text AS reference, b.text AS hypothesis FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
# DuckDB's distance counts bytes: each distinct character of a pair becomes a byte
LETTERS = """ch AS (SELECT item_id, list_filter(string_split(r, ''), lambda x: x <> '') AS r, list_filter(string_split(h, ''), lambda x: x <> '') AS h FROM n), cv AS (SELECT *, list_distinct(list_concat(r, h)) AS d FROM ch),
cb AS (SELECT item_id, len(r) AS k, array_to_string(list_transform(r, lambda x: chr(CAST(32 + list_position(d, x) AS INTEGER))), '') AS r, array_to_string(list_transform(h, lambda x: chr(CAST(32 + list_position(d, x) AS INTEGER))), '') AS h FROM cv),
cr AS (SELECT item_id, CAST(levenshtein(r, h) AS INTEGER) AS char_errors, CAST(k AS INTEGER) AS ref_chars FROM cb)"""
BARE = f"n AS (SELECT item_id, replace({NORM.format('reference')}, ' ', '') AS r, replace({NORM.format('hypothesis')}, ' ', '') AS h FROM tx)"


@query(f"WITH {TEXTS}, {BARE}, {LETTERS} SELECT item_id, char_errors, ref_chars, round(char_errors / ref_chars, 6) AS cer FROM cr")
def cer_ascii(spark, sf):
    return metrics.character_errors(_texts(spark, sf)).select("item_id", "char_errors", "ref_chars", F.round("cer", 6).alias("cer"))


def distances_sql(name: str, pairs: str, keys: str) -> str:
    """name: keys, errors, n_words of the relation pairs (keys, r, h lists of words).

    The table of distances row by row: a cell needs the row before and the least of what lies to its left, which is found by
    doubling (up to 4,096 words)."""
    step = "c0"
    inner = f"SELECT {keys}, r, h, i + 1 AS i, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(d[j + 1] + 1, d[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END) - j END) AS c FROM {name}_t WHERE i < len(r)"
    for k in range(12):
        inner = f"SELECT {keys}, r, h, i, CASE WHEN len(c) <= {1 << k} THEN c ELSE list_transform(range(1, len(c) + 1), lambda j: least(c[j], CASE WHEN j > {1 << k} THEN c[j - {1 << k}] END)) END AS c FROM ({inner}) {step}{k}"
    return f"""{name}_v AS (SELECT *, list_distinct(list_concat(r, h)) AS v FROM {pairs}), {name}_n AS MATERIALIZED (SELECT {keys}, list_transform(r, lambda x: list_position(v, x)) AS r, list_transform(h, lambda x: list_position(v, x)) AS h FROM {name}_v),
{name}_t AS (SELECT {keys}, r, h, 0::BIGINT AS i, list_transform(range(0, len(h) + 1), lambda j: j) AS d FROM {name}_n UNION ALL SELECT {keys}, r, h, i, list_transform(range(1, len(c) + 1), lambda j: j - 1 + c[j]) FROM ({inner}) x),
{name} AS (SELECT {keys}, CAST(d[-1] AS INTEGER) AS errors, CAST(len(r) AS INTEGER) AS n_words FROM {name}_t WHERE i = len(r))"""


def _words_sql(text_: str) -> str:
    return f"list_filter(string_split({NORM.format(text_)}, ' '), lambda x: x <> '')"


WER = f"""RECURSIVE {TEXTS}, w AS (SELECT item_id, {_words_sql('reference')} AS r, {_words_sql('hypothesis')} AS h FROM tx), {distances_sql('er', 'w', 'item_id')}"""


@query(f"WITH {WER} SELECT item_id, errors, n_words, round(errors / n_words, 6) AS wer FROM er")
def wer(spark, sf):
    return metrics.word_errors(_texts(spark, sf)).select("item_id", "errors", "n_words", F.round("wer", 6).alias("wer"))


@query(f"WITH {WER} SELECT item_id % 5 AS meeting, count(*) AS n, round(sum(errors) / sum(n_words), 6) AS micro, round(avg(errors / n_words), 6) AS macro FROM er GROUP BY 1")
def micro_macro(spark, sf):
    x = metrics.word_errors(_texts(spark, sf)).withColumn("meeting", F.col("item_id") % 5)
    return reports.micro_macro(x, ["meeting"]).select("meeting", "n", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query(f"WITH {WER} SELECT coalesce(item_id % 5, -1) AS meeting, count(*) AS n, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(n_words) AS BIGINT) AS n_words, round(sum(errors) / sum(n_words), 6) AS micro, round(avg(errors / n_words), 6) AS macro FROM er GROUP BY ROLLUP (item_id % 5)")
def score_rollup(spark, sf):
    x = metrics.word_errors(_texts(spark, sf)).withColumn("meeting", F.col("item_id") % 5).withColumn("rate", F.col("wer"))
    return reports.score_rollup(x, "meeting").withColumns({"meeting": F.coalesce("meeting", F.lit(-1)), "micro": F.round("micro", 6), "macro": F.round("macro", 6)})


@query("SELECT CAST(count_if(l_discount = 0) AS BIGINT) AS perfect, CAST(count_if(l_discount > 0 AND l_discount <= 0.1) AS BIGINT) AS good, CAST(count_if(l_discount > 0.1 AND l_discount <= 0.3) AS BIGINT) AS fair, CAST(count_if(l_discount > 0.3) AS BIGINT) AS poor FROM lineitem")
def wer_histogram(spark, sf):
    return reports.rate_histogram(table(spark, sf, "lineitem"), "l_discount")


@query("SELECT best, worst FROM (SELECT arg_min(event_id, {'v': value, 'e': event_id}) AS best, arg_min(event_id, {'v': -value, 'e': event_id}) AS worst FROM events)")
def best_worst(spark, sf):
    return reports.best_worst(table(spark, sf, "events"), "value", "event_id")


@query("SELECT o_orderpriority AS metric, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 2) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high, round(max(o_totalprice) - min(o_totalprice), 2) AS range FROM orders GROUP BY 1")
def noise_floor(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric"), "o_totalprice")
    return reports.noise_floor(x, "metric", "o_totalprice").select("metric", "n", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), "low", "high", F.round("range", 2).alias("range"))


@query("WITH m AS (SELECT l_linestatus AS metric, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS b FROM lineitem GROUP BY 1) SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN abs(b - a) < 0.5 THEN 'noise' WHEN b - a < 0 THEN 'b better' ELSE 'a better' END AS verdict FROM m")
def ab_delta(spark, sf):
    x = reports.ab_delta(table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("metric"), "l_returnflag", "l_quantity"), "l_returnflag", "A", "R", "metric", "l_quantity")
    return x.withColumns({c: F.round(c, 6) for c in ("a", "b", "delta")}).select("metric", "a", "b", "delta", F.coalesce("verdict", F.lit("a better")).alias("verdict"))


DECISIONS = """de AS (SELECT event_id, event_type AS decision, CASE WHEN event_id % 11 = 0 THEN 'Unknown' WHEN event_id % 13 = 0 THEN NULL ELSE 'SPEAKER_' || CAST(event_id % 4 AS VARCHAR) END AS assigned,
  'R' || CAST(event_id % 4 AS VARCHAR) AS mapped, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'R' || CAST(user_id % 4 AS VARCHAR) END AS reference, CAST(floor(value) AS DOUBLE) AS seconds, CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id % 23) / 100.0::DOUBLE END AS margin FROM events)"""


def _decisions(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    name = lambda p, x: F.concat(F.lit(p), (x % 4).cast("string"))
    return e.select("event_id", F.col("event_type").alias("decision"), F.when(i % 11 == 0, "Unknown").when(i % 13 != 0, name("SPEAKER_", i)).alias("assigned"), name("R", i).alias("mapped"), F.when(i % 17 != 0, name("R", u)).alias("reference"), F.floor("value").cast("double").alias("seconds"), F.when(i % 19 != 0, i % 23 / 100.0).alias("margin"))


@query(f"""WITH {DECISIONS}, j AS (SELECT *, coalesce(assigned = 'Unknown', true) AS u, NOT coalesce(assigned = 'Unknown', true) AND reference IS NOT NULL AND mapped IS DISTINCT FROM reference AS w FROM de)
SELECT decision, count(*) AS n, CAST(count_if(w) AS BIGINT) AS wrong, CAST(count_if(u) AS BIGINT) AS unknown, sum(seconds) AS seconds, coalesce(sum(seconds) FILTER (w), 0) AS wrong_seconds, round(count_if(w) / (count(*) - count_if(u)), 6) AS rate FROM j GROUP BY 1""")
def decision_accuracy(spark, sf):
    return reports.decision_accuracy(_decisions(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {DECISIONS}, j AS (SELECT CASE WHEN margin < 0.06 THEN 'unclear' WHEN margin < 0.15 THEN 'middle' ELSE 'clear' END AS band, mapped IS DISTINCT FROM reference AS w FROM de WHERE assigned IS NOT NULL AND assigned <> 'Unknown' AND reference IS NOT NULL AND margin IS NOT NULL)
SELECT band, count(*) AS n, CAST(count_if(w) AS BIGINT) AS wrong, round(count_if(w) / count(*), 6) AS rate FROM j GROUP BY 1""")
def margin_band(spark, sf):
    return reports.banded(_decisions(spark, sf), "margin", [0.06, 0.15], ["unclear", "middle", "clear"]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {CONV} SELECT session, speaker, string_agg(trim(text), ' ' ORDER BY \"start\", pos) AS text FROM conv WHERE trim(text) <> '' GROUP BY ALL")
def concat_by_speaker(spark, sf):
    return segments.concat_by_speaker(conv_view(spark, sf))


@query(f"WITH {SEG}, t AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 300) SELECT session, pos, speaker, coalesce(lag(speaker) OVER (PARTITION BY session ORDER BY pos) = speaker, false) AS continues FROM t")
def continuation_flags(spark, sf):
    return segments.continuation(seg_view(spark, sf)).select("session", "pos", "speaker", "continues")


@query("SELECT user_id, event_id AS block, value AS rms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def energy_topk(spark, sf):
    x = table(spark, sf, "events").select("user_id", F.col("event_id").alias("block"), F.col("value").alias("rms"))
    return reports.energy_top(x, "user_id", 5)


@query("SELECT doc_id, CASE WHEN n_chars <= 100 THEN n_chars % 10 = 0 ELSE n_chars % 20 = 0 END AS due FROM documents")
def cadence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reports.partial_due(F.col("n_chars")).alias("due"))


@query("""WITH c AS (SELECT user_id, event_id, floor(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, count(*) AS n, round(avg(v + 1), 6) AS mean_latency, median(v + 1) AS median_latency, round(sum(v + 1) / sum(v * 4 + 2), 6) AS rtf FROM c WHERE n > 2 GROUP BY 1""")
def latency_stats(spark, sf):
    v = F.floor("value").cast("double")
    x = table(spark, sf, "events").select("user_id", F.col("event_id").alias("chunk"), (v + 1).alias("latency"), v.alias("stt"), F.lit(1.0).alias("diar"), (v * 4 + 2).alias("audio"))
    return reports.latency(x, "user_id", 2).withColumns({"mean_latency": F.round("mean_latency", 6), "rtf": F.round("rtf", 6)})


@query("SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high, count(DISTINCT source) AS n_speakers FROM documents")
def dataset_summary(spark, sf):
    return reports.dataset_summary(table(spark, sf, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


@query("SELECT l_orderkey, n, q, n_same FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, row_number() OVER (PARTITION BY count(*), sum(l_quantity) ORDER BY l_orderkey) AS r, count(*) OVER (PARTITION BY count(*), sum(l_quantity)) AS n_same FROM lineitem GROUP BY 1) WHERE r = 1")
def outcome_dedup(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return reports.outcome_dedup(x.withColumn("sig", F.struct("n", "q")), "sig", "l_orderkey").drop("sig")


@query("SELECT p_brand, p_size, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean, p_brand, p_size) = 1 AS best FROM (SELECT p_brand, p_size, avg(floor(p_retailprice)) AS mean FROM part GROUP BY ALL)")
def sweep_cells(spark, sf):
    x = table(spark, sf, "part").withColumn("v", F.floor("p_retailprice").cast("double"))
    return reports.sweep_cells(x, ["p_brand", "p_size"], "v").withColumn("mean", F.round("mean", 6))


TASKS = "tk AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'final' ELSE 'partial' END AS type FROM events)"


@query(f"WITH {TASKS}, x AS (SELECT *, max(seq) FILTER (type = 'final') OVER w AS f, max(seq) FILTER (type = 'partial') OVER w AS p FROM tk WINDOW w AS (PARTITION BY user_id)) SELECT user_id, seq, type FROM x WHERE type = 'final' OR (seq = p AND (f IS NULL OR seq > f))")
def coalesce_latest(spark, sf):
    x = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "final").otherwise("partial").alias("type"))
    return upserts.coalesce_tasks(x, ["user_id"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf):
    return upserts.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH e AS (SELECT user_id AS session, event_id AS seq, CAST(event_id % 12 AS BIGINT) AS i, event_type, CAST(event_id AS VARCHAR) AS text, event_type = 'view' AS provisional FROM events WHERE event_type <> 'error'),
t AS (SELECT *, event_type <> 'signup' AS fin, max(CASE WHEN event_type <> 'signup' THEN i END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
o AS (SELECT *, coalesce(max(CASE WHEN NOT fin AND i <= top THEN 1 END) OVER (PARTITION BY session, i ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM t),
k AS (SELECT session, i, arg_max(text, seq) AS text FROM o WHERE (fin OR i <= top) AND NOT (fin AND provisional AND done = 1) GROUP BY ALL),
p AS (SELECT session, unnest(range(0, max(i) + 1)) AS i FROM e WHERE event_type <> 'signup' GROUP BY session)
SELECT p.session, p.i AS segment_index, coalesce(k.text, '') AS text FROM p LEFT JOIN k USING (session, i)""")
def transcript_view(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'error'")
    x = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 12).alias("segment_index"), F.when(F.col("event_type") == "signup", "speaker_update").otherwise("final").alias("type"), (F.col("event_type") == "view").alias("provisional"), F.col("event_id").cast("string").alias("text"))
    return upserts.transcript_view(x)


@query(f"WITH {SEG}, long AS (SELECT * FROM seg QUALIFY count(*) OVER (PARTITION BY session) >= 3), c AS (SELECT * FROM ({_rule_sql('long', GAP)})) SELECT DISTINCT session, pos // 5 AS chunk FROM c")
def semi_touched(spark, sf):
    x = seg_view(spark, sf).withColumn("refined_from0", F.col("speaker"))
    y = islands.apply_rule(x, islands.gap_changes, RULES).withColumn("refined_from", F.when(F.col("speaker") != F.col("refined_from0"), F.col("refined_from0"))).withColumn("chunk", F.floor(F.col("pos") / 5))
    return islands.touched(y, ["session", "chunk"]).select("session", "chunk").distinct()


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_cache_miss(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return intervals.misses(table(spark, sf, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    """VEC-09."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 5000 AS s, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS pretty FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def pretty_duration(spark, sf):
    s = F.floor("o_totalprice").cast("bigint") % 5000
    return table(spark, sf, "orders").select("o_orderkey", s.alias("s"), num.pretty_duration(s).alias("pretty"))


@query("SELECT o_orderkey, (h || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(x::VARCHAR, 2, '0') || '.5') AS clock, CAST(h * 3600 + m * 60 + x AS DOUBLE) + 0.5 AS seconds FROM (SELECT o_orderkey, o_orderkey % 7 AS h, o_custkey % 60 AS m, o_orderkey % 60 AS x FROM orders)")
def parse_time(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    clock = F.concat((k % 7).cast("string"), F.lit(":"), two(c % 60), F.lit(":"), two(k % 60), F.lit(".5"))
    return table(spark, sf, "orders").select("o_orderkey", clock.alias("clock"), num.parse_time(clock).alias("seconds"))


@query("SELECT event_id, round(0.55 + (1 - q) * 0.08 + (1 - m) * 0.06, 6) AS threshold FROM (SELECT event_id, greatest(0.25, least(1, (value / 50 - 0.35) / 1.85)) AS q, least(1, 0.45 + 0.55 * (value / 8)) AS m FROM events)")
def effective_threshold(spark, sf):
    q, m = num.duration_quality(F.col("value") / 50), num.maturity(F.col("value"))
    return table(spark, sf, "events").select("event_id", F.round(num.effective_threshold(0.55, q, m), 6).alias("threshold"))


@query("SELECT session, count(DISTINCT speaker) FILTER (speaker <> 'Unknown') AS n_speakers FROM (SELECT conv_id AS session, CASE WHEN role = 'system' THEN 'Unknown' ELSE role END AS speaker FROM conversations) GROUP BY 1")
def real_speakers(spark, sf):
    return segments.real_speakers(conv_view(spark, sf))


def _frames(spark, sf) -> DataFrame:
    """Events as frames of a user: a click or view is speech."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("session"), (F.row_number().over(w) - 1).cast("bigint").alias("frame"), F.col("event_type").isin("click", "view").alias("speech"))


# one step a frame: the state of the open chunk behind it, and what it closes or shows
@query("""WITH RECURSIVE fr AS MATERIALIZED (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, event_type IN ('click', 'view') AS sp, count(*) OVER (PARTITION BY user_id) AS total FROM events),
st AS (SELECT DISTINCT session, -1::BIGINT AS f, NULL::BIGINT AS b, 0::BIGINT AS n, 0::BIGINT AS quiet, 0::BIGINT AS trim, 0::BIGINT AS made, 0::BIGINT AS lead, NULL::VARCHAR AS why, NULL::BIGINT AS cb, NULL::BIGINT AS cn, NULL::BIGINT AS ct, NULL::BIGINT AS pn, NULL::BIGINT AS pt FROM fr UNION ALL
  SELECT session, f, CASE why WHEN 'silence' THEN NULL WHEN 'max' THEN f + 1 - least(3, n) ELSE b END, CASE WHEN why = 'silence' OR b IS NULL THEN 0 WHEN why = 'max' THEN least(3, n) ELSE n END, CASE WHEN why IS NOT NULL OR b IS NULL THEN 0 ELSE quiet END, CASE WHEN why = 'silence' OR b IS NULL THEN 0 WHEN why = 'max' THEN least(3, n) ELSE trim END,
    made + CASE WHEN why IS NULL THEN 0 ELSE 1 END, lead, why, CASE WHEN why IS NOT NULL THEN b END, CASE WHEN why IS NOT NULL THEN n END, CASE WHEN why IS NOT NULL THEN trim END, CASE WHEN b IS NOT NULL AND n % CASE WHEN n <= 100 THEN 10 ELSE 20 END = 0 THEN least(n, 133) END, CASE WHEN n <= 133 THEN trim ELSE 0 END
  FROM (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN quiet > CASE WHEN n * 30 > 300 THEN 1 ELSE 3 END THEN 'silence' WHEN n * 30 >= 600 THEN 'max' END AS why FROM (
    SELECT session, f, CASE WHEN b0 IS NOT NULL THEN b0 WHEN sp THEN f - lead0 END AS b, CASE WHEN b0 IS NOT NULL THEN n0 + 1 WHEN sp THEN lead0 + 1 ELSE 0 END AS n, CASE WHEN sp OR b0 IS NULL THEN 0 ELSE quiet0 + 1 END AS quiet, trim, made, CASE WHEN b0 IS NOT NULL THEN lead0 WHEN sp THEN 0 ELSE least(lead0 + 1, 2) END AS lead
    FROM (SELECT fr.session, fr.f, fr.sp, st.b AS b0, st.n AS n0, st.quiet AS quiet0, st.trim, st.made, st.lead AS lead0 FROM st JOIN fr ON fr.session = st.session AND fr.f = st.f + 1)))),
o AS (SELECT session, made - 1 AS chunk, 'final' AS type, cb AS start_frame, cn AS n_frames, ct AS trim_frames, why AS reason FROM st WHERE why IS NOT NULL
  UNION ALL SELECT session, made - CASE WHEN why IS NULL THEN 0 ELSE 1 END, 'partial', f + 1 - pn, pn, pt, 'cadence' FROM st WHERE pn IS NOT NULL
  UNION ALL SELECT st.session, st.made, 'final', st.b, st.n, st.trim, 'end' FROM st JOIN fr USING (session, f) WHERE f + 1 = total AND b IS NOT NULL)
SELECT CAST(session AS VARCHAR) AS session, CAST(chunk AS INTEGER) AS chunk, type, CAST(start_frame AS BIGINT) AS start_frame, CAST(n_frames AS INTEGER) AS n_frames, CAST(trim_frames AS INTEGER) AS trim_frames, reason FROM o""")
def chunker(spark, sf):
    return chunking.chunk_batch(_frames(spark, sf), chunking.Settings(silence_limit=3, short_silence_limit=1, soft_ms=300, max_ms=600, preroll_ms=60, overlap_ms=90, partials=True))


@query()
def tracker(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("label").alias("session"), F.floor(F.col("vec_id") / 20).alias("chunk"), F.concat(F.lit("L"), (F.col("vec_id") % 2).cast("string")).alias("local"), "embedding", F.lit(2.5).alias("seconds"), F.lit(6000.0).alias("chunk_ms"))
    return tracking.track(rows, tracking.Settings(threshold=0.3, self_similarity=0.3))


STEPS = """nn AS MATERIALIZED (SELECT session, pos, speaker, greatest("end" - "start", 0) AS d, lead(speaker) OVER w AS q, lag(greatest("end" - "start", 0)) OVER w AS pd, lead(greatest("end" - "start", 0)) OVER w AS qd, count(*) OVER (PARTITION BY session) AS c FROM seg WINDOW w AS (PARTITION BY session ORDER BY pos)),
f AS (SELECT session, pos, speaker FROM nn WHERE pos = 1 UNION ALL SELECT nn.session, nn.pos, CASE WHEN nn.pos = c OR d >= 30 THEN nn.speaker {0} ELSE nn.speaker END FROM f JOIN nn ON nn.session = f.session AND nn.pos = f.pos + 1)"""


@query(f"WITH RECURSIVE {SEG}, {STEPS.format('WHEN f.speaker = q AND nn.speaker <> f.speaker THEN f.speaker')} SELECT session, pos, speaker FROM f")
def smooth_labels(spark, sf):
    return smoothing.smooth(seg_view(spark, sf), "live", 30.0)


@query(f"WITH RECURSIVE {SEG}, {STEPS.format('WHEN nn.speaker <> f.speaker AND nn.speaker <> q THEN CASE WHEN qd > pd THEN q ELSE f.speaker END')} SELECT session, pos, speaker FROM f")
def smooth_labels_eval(spark, sf):
    return smoothing.smooth(seg_view(spark, sf), "eval", 30.0)


# one step a window: where a region began, since when it has been quiet, and the region that this window closes
@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, row_number() OVER w - 1 AS i, least(1.0, value / 80) AS p, count(*) OVER (PARTITION BY user_id) * 512 AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, i, CASE WHEN p >= 0.5 THEN 0::BIGINT END AS b, NULL::BIGINT AS q, NULL::BIGINT AS eb, NULL::BIGINT AS ee FROM e WHERE i = 0 UNION ALL
  SELECT user_id, i, CASE WHEN p >= 0.5 THEN coalesce(b, here) WHEN shut THEN NULL ELSE b END, CASE WHEN p >= 0.5 OR shut THEN NULL WHEN p < 0.35 AND b IS NOT NULL THEN coalesce(q, here) ELSE q END, CASE WHEN shut THEN b END, CASE WHEN shut THEN coalesce(q, here) END
  FROM (SELECT e.user_id, e.i, e.p, e.i * 512 AS here, s.b, s.q, e.p < 0.35 AND s.b IS NOT NULL AND e.i * 512 - coalesce(s.q, e.i * 512) >= 640 AS shut FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)),
r AS (SELECT user_id, eb AS b, ee AS e FROM s WHERE eb IS NOT NULL UNION ALL SELECT s.user_id, s.b, e.total FROM s JOIN e USING (user_id, i) WHERE (s.i + 1) * 512 = e.total AND s.b IS NOT NULL),
k AS (SELECT r.*, row_number() OVER w - 1 AS region, lag(r.e) OVER w AS pe, lead(r.b) OVER w AS nb, (SELECT max(total) FROM e WHERE e.user_id = r.user_id) AS total FROM r WHERE r.e - r.b > 480 WINDOW w AS (PARTITION BY r.user_id ORDER BY r.b))
SELECT user_id, CAST(region AS INTEGER) AS region, CASE WHEN pe IS NULL THEN greatest(0, b - 480) ELSE b - CASE WHEN b - pe < 960 THEN (b - pe) // 2 ELSE 480 END END AS "start",
  CASE WHEN nb IS NULL THEN least(total, e + 480) ELSE e + CASE WHEN nb - e < 960 THEN (nb - e) // 2 ELSE 480 END END AS "end" FROM k""")
def hysteresis(spark, sf):
    from ..operators.speech import speech_regions

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("window"), F.least(F.lit(1.0), F.col("value") / 80).alias("prob"))
    return speech_regions(x, "user_id", min_silence_ms=40, min_speech_ms=30)


def _two_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A session's segments as reference, and with labels shifted and smoothed as hypothesis."""
    s = seg_view(spark, sf).withColumn("meeting", F.col("session"))
    h = s.withColumns({"start": F.col("start") + 1.5, "end": F.col("end") + 1.0, "speaker": F.concat(F.lit("h_"), F.when(F.col("pos") % 7 == 0, "Unknown").otherwise(F.col("speaker")))})
    return s, h.where("end > start")


def der_sql(rf: str, hy: str, half: float) -> str:
    """dr: m, total, fa, mi, co of the relations rf and hy (m, a, b, s): elementary intervals, shared time by pairs of labels,
    and the best of all one-to-one pairings."""
    marks = f"UNION SELECT m, t - {half} FROM mk UNION SELECT m, t + {half} FROM mk" if half else ""
    near = f"AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.m = iv.m AND abs((iv.a + iv.b) / 2 - t) < {half})" if half else ""
    return f"""mk AS (SELECT m, a AS t FROM {rf} UNION SELECT m, b FROM {rf}), ct AS (SELECT m, t FROM mk {marks} UNION SELECT m, a FROM {hy} UNION SELECT m, b FROM {hy}),
iv AS (SELECT m, t AS a, lead(t) OVER (PARTITION BY m ORDER BY t) AS b FROM ct), el AS MATERIALIZED (SELECT iv.m, a, b, (a + b) / 2 AS x FROM iv WHERE b IS NOT NULL {near}),
ra AS MATERIALIZED (SELECT DISTINCT el.m, el.a, el.b, s FROM el JOIN {rf} q ON q.m = el.m AND q.a < el.x AND q.b > el.x), ha AS MATERIALIZED (SELECT DISTINCT el.m, el.a, el.b, s FROM el JOIN {hy} q ON q.m = el.m AND q.a < el.x AND q.b > el.x),
dn AS (SELECT el.m, el.a, el.b - el.a AS w, (SELECT count(*) FROM ra WHERE ra.m = el.m AND ra.a = el.a) AS nr, (SELECT count(*) FROM ha WHERE ha.m = el.m AND ha.a = el.a) AS nh FROM el),
dt AS (SELECT m, sum(nr * w) AS total, sum(greatest(nh - nr, 0) * w) AS fa, sum(greatest(nr - nh, 0) * w) AS mi, sum(least(nr, nh) * w) AS both_ FROM dn GROUP BY m),
sh AS MATERIALIZED (SELECT ra.m, ra.s AS r, ha.s AS h, sum(ra.b - ra.a) AS w FROM ra JOIN ha ON ha.m = ra.m AND ha.a = ra.a GROUP BY ALL), rn AS MATERIALIZED (SELECT m, r, row_number() OVER (PARTITION BY m ORDER BY r) AS k FROM (SELECT DISTINCT m, r FROM sh)),
pm AS (SELECT DISTINCT m, 0::BIGINT AS k, ''::VARCHAR AS used, 0::DOUBLE AS w FROM sh UNION ALL
  SELECT pm.m, pm.k + 1, pm.used || coalesce('|' || c.h || '|', ''), pm.w + coalesce(c.w, 0) FROM pm JOIN rn ON rn.m = pm.m AND rn.k = pm.k + 1 JOIN (SELECT m, r, h, w FROM sh UNION ALL SELECT DISTINCT m, r, NULL, 0 FROM sh) c ON c.m = pm.m AND c.r = rn.r AND (c.h IS NULL OR NOT contains(pm.used, '|' || c.h || '|'))),
bs AS (SELECT m, max(w) AS w FROM pm GROUP BY m), dr AS (SELECT dt.m, total, fa, mi, both_ - coalesce(bs.w, 0) AS co FROM dt LEFT JOIN bs ON bs.m = dt.m)"""


@query(f"""WITH RECURSIVE {SEG}, rf AS (SELECT session AS m, "start" AS a, "end" AS b, speaker AS s FROM seg WHERE "end" > "start"),
hy AS (SELECT session AS m, "start" + 1.5 AS a, "end" + 1.0 AS b, 'h_' || CASE WHEN pos % 7 = 0 THEN 'Unknown' ELSE speaker END AS s FROM seg WHERE "end" + 1.0 > "start" + 1.5), {der_sql('rf', 'hy', 0.125)}
SELECT m AS meeting, abs(round(total, 6)) AS total, abs(round(fa, 6)) AS false_alarm, abs(round(mi, 6)) AS miss, abs(round(co, 6)) AS confusion, abs(round((fa + mi + co) / greatest(total, 1e-8), 6)) AS der FROM dr""")
def der(spark, sf):
    r, h = _two_sides(spark, sf)
    x = metrics.diarization_errors(r, h, "meeting", collar=0.25)
    return x.select("meeting", *[F.abs(F.round(c, 6)).alias(c) for c in ("total", "false_alarm", "miss", "confusion", "der")])


def cpwer_sql(hyp_speaker: str) -> str:
    """cp: session, errors, n_words over conv: all one-to-one pairings of its speakers with those of another labelling.
    What a hypothesis speaker costs unpaired is taken off when it is paired."""
    by = lambda spk, out: f"SELECT session, {spk} AS {out}, {_words_sql("string_agg(trim(text), ' ' ORDER BY " + chr(34) + "start" + chr(34) + ", pos)")} AS w FROM conv WHERE trim(text) <> '' GROUP BY ALL"
    return f"""cr_ AS MATERIALIZED ({by("speaker", "a")}), ch_ AS MATERIALIZED ({by(hyp_speaker, "b")}), pw AS (SELECT session, a, b, cr_.w AS r, ch_.w AS h FROM cr_ JOIN ch_ USING (session)), {distances_sql("pe", "pw", "session, a, b")},
co AS MATERIALIZED (SELECT pe.session, a, b, pe.errors - len(ch_.w) AS e FROM pe JOIN ch_ USING (session, b) UNION ALL SELECT session, a, NULL, len(w) FROM cr_), cn AS MATERIALIZED (SELECT session, a, row_number() OVER (PARTITION BY session ORDER BY a) AS k, count(*) OVER (PARTITION BY session) AS many FROM cr_),
cq AS (SELECT DISTINCT session, 0::BIGINT AS k, ''::VARCHAR AS used, 0::BIGINT AS e FROM cr_ UNION ALL SELECT cq.session, cq.k + 1, cq.used || coalesce('|' || co.b || '|', ''), cq.e + co.e FROM cq JOIN cn ON cn.session = cq.session AND cn.k = cq.k + 1 JOIN co ON co.session = cq.session AND co.a = cn.a AND (co.b IS NULL OR NOT contains(cq.used, '|' || co.b || '|'))),
cp AS (SELECT cq.session, min(cq.e) + any_value(t.h) AS errors, any_value(t.r) AS n_words FROM cq JOIN (SELECT session, (SELECT sum(len(w)) FROM ch_ WHERE ch_.session = x.session) AS h, sum(len(w)) AS r, count(*) AS n FROM cr_ x GROUP BY session) t ON t.session = cq.session AND cq.k = t.n GROUP BY cq.session)"""


@query(f"WITH RECURSIVE {CONV}, {cpwer_sql("CASE WHEN pos % 3 = 0 THEN 'S2' ELSE 'S' || CAST(pos % 2 AS VARCHAR) END")} SELECT session, CAST(errors AS BIGINT) AS errors, CAST(n_words AS BIGINT) AS n_words, round(errors / n_words, 6) AS cpwer FROM cp")
def cpwer(spark, sf):
    c = conv_view(spark, sf)
    r = segments.concat_by_speaker(c)
    h = segments.concat_by_speaker(c.withColumn("speaker", F.when(F.col("pos") % 3 == 0, "S2").otherwise(F.concat(F.lit("S"), (F.col("pos") % 2).cast("string")))))
    return metrics.speaker_permutation_errors(r, h, "session").select("session", "errors", "n_words", F.round("cpwer", 6).alias("cpwer"))


@query(f"WITH {WER} SELECT item_id, errors, n_words FROM er")
def wer_sid(spark, sf):
    x = metrics.word_error_details(_texts(spark, sf), ["item_id"])
    return x.select("item_id", (F.col("substitutions") + F.col("insertions") + F.col("deletions")).alias("errors"), "n_words")


@query("""WITH RECURSIVE w AS (SELECT l_orderkey % 50 AS meeting, l_returnflag AS hypothesis, l_linestatus AS reference, sum(l_quantity) AS weight, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY weight DESC, pos, hypothesis, reference) AS k FROM w),
g AS (SELECT meeting, 0::BIGINT AS k, [''] AS l, [''] AS r, false AS taken, NULL::VARCHAR AS hypothesis, NULL::VARCHAR AS reference, NULL::DOUBLE AS weight FROM (SELECT DISTINCT meeting FROM o) UNION ALL
  SELECT meeting, k, CASE WHEN free THEN list_append(l, hypothesis) ELSE l END, CASE WHEN free THEN list_append(r, reference) ELSE r END, free, hypothesis, reference, weight FROM (SELECT o.meeting, o.k, g.l, g.r, o.hypothesis, o.reference, o.weight, NOT list_contains(g.l, o.hypothesis) AND NOT list_contains(g.r, o.reference) AS free FROM g JOIN o ON o.meeting = g.meeting AND o.k = g.k + 1))
SELECT meeting, hypothesis, reference, weight FROM g WHERE taken""")
def greedy_match(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.groupBy((F.col("l_orderkey") % 50).alias("meeting"), F.col("l_returnflag").alias("hypothesis"), F.col("l_linestatus").alias("reference")).agg(F.sum("l_quantity").alias("weight"), F.min("l_linenumber").alias("pos"))
    return metrics.greedy_mapping(x, "meeting")


def _gram_sql(name: str, orders: int) -> str:
    """name: item_id, r, h lists of tokens; clipped counts of all orders."""
    parts = []
    for n in range(1, orders + 1):
        side = lambda c: f"SELECT item_id, array_to_string({c}[i:i + {n - 1}], chr(1)) AS g, count(*) AS k FROM (SELECT item_id, {c}, unnest(range(1, len({c}) - {n} + 2)) AS i FROM {name}) GROUP BY ALL"  # noqa: B023, E731
        parts.append(f"SELECT {n} AS n, coalesce(sum(least(coalesce(a.k, 0), coalesce(b.k, 0))), 0) AS matches, coalesce(sum(b.k), 0) AS hyp, coalesce(sum(a.k), 0) AS ref FROM ({side('r')}) a FULL JOIN ({side('h')}) b ON a.item_id = b.item_id AND a.g = b.g")
    return " UNION ALL ".join(parts)


_SPLIT = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda x: x <> '')"
_APART = "regexp_replace({0}, '([\\p{{P}}\\p{{S}}])', ' \\1 ', 'g')"
SCORES_SQL = f"""{TEXTS}, bw AS (SELECT item_id, {_SPLIT.format('reference')} AS r, {_SPLIT.format('hypothesis')} AS h FROM tx),
bg AS ({_gram_sql('bw', 4)}), bx AS (SELECT n, matches, hyp, sum(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM bg WHERE hyp > 0),
bl AS (SELECT sum(ln(CASE WHEN matches = 0 THEN 1.0 / (pow(2, z) * hyp) ELSE matches / hyp END)) AS l, count(*) AS orders FROM bx), bs AS (SELECT sum(len(r)) AS lr, sum(len(h)) AS lh FROM bw),
bleu AS (SELECT CASE WHEN orders = 4 AND lh > 0 THEN 100 * CASE WHEN lh >= lr THEN 1.0 ELSE exp(1 - lr / lh) END * exp(l / 4) ELSE 0.0 END AS v FROM bl, bs),
cc AS (SELECT item_id, list_filter(string_split(regexp_replace(reference, '\\s+', '', 'g'), ''), lambda x: x <> '') AS r, list_filter(string_split(regexp_replace(hypothesis, '\\s+', '', 'g'), ''), lambda x: x <> '') AS h FROM tx),
cw AS (SELECT item_id, {_SPLIT.format(_APART.format('reference'))} AS r, {_SPLIT.format(_APART.format('hypothesis'))} AS h FROM tx),
cg AS ({_gram_sql('cc', 6)} UNION ALL {_gram_sql('cw', 2)}), cp AS (SELECT CASE WHEN hyp > 0 THEN matches / hyp ELSE 0 END AS p, CASE WHEN ref > 0 THEN matches / ref ELSE 0 END AS r FROM cg WHERE hyp > 0 OR ref > 0),
chrf AS (SELECT 100 * avg(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END) AS v FROM cp)"""


@query(f"WITH {SCORES_SQL} SELECT 'bleu' AS metric, round(v, 6) AS value FROM bleu UNION ALL SELECT 'chrf', round(v, 6) FROM chrf")
def bleu_chrf(spark, sf):
    x = _texts(spark, sf)
    return metrics.bleu(x, "item_id").select(F.lit("bleu").alias("metric"), F.round("bleu", 6).alias("value")).union(metrics.chrf(x, "item_id").select(F.lit("chrf"), F.round("chrf", 6)))


# --- further operators ---


@query(f"WITH {SEG}, t AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 200), n AS (SELECT session, 'SPEAKER_0' || CAST(pos % 4 AS VARCHAR) AS speaker, \"end\" - \"start\" AS d FROM t WHERE speaker <> 'Unknown') SELECT session, speaker, round(sum(d), 2) AS seconds, count(*) AS n_segments FROM n GROUP BY ALL")
def speaker_log(spark, sf):
    """AGG-03."""
    s = seg_view(spark, sf).withColumn("speaker", F.when(F.col("speaker") != "Unknown", F.concat(F.lit("SPEAKER_0"), (F.col("pos") % 4).cast("string"))).otherwise("Unknown"))
    return segments.log_summary(s).withColumn("seconds", F.round("seconds", 2))


@query(f"WITH {CONV}, c AS (SELECT *, pos // 3 AS chunk FROM conv) SELECT session, chunk, arg_min(speaker, pos) AS speaker, arg_min(\"start\", pos) AS \"start\", arg_max(\"end\", pos) AS \"end\", string_agg(trim(text), ' ' ORDER BY pos) FILTER (trim(text) <> '') AS text FROM c GROUP BY ALL")
def merge_chunk(spark, sf):
    """FLT-11."""
    return segments.merge_chunk(conv_view(spark, sf).withColumn("chunk", F.floor(F.col("pos") / 3)), ["session", "chunk"])


@query(f"""WITH {SEG}, w AS (SELECT session, pos, CASE WHEN speaker = 'Unknown' THEN 'click' ELSE speaker END AS speaker, "start", "end", ' w' || CAST(pos AS VARCHAR) AS word, pos % 9 = 0 AS wordless FROM seg),
r AS (SELECT *, CASE WHEN lag(speaker) OVER o IS DISTINCT FROM speaker OR wordless OR coalesce(lag(wordless) OVER o, true) THEN 1 ELSE 0 END AS b FROM w WINDOW o AS (PARTITION BY session ORDER BY pos)),
n AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT session, CAST(run AS BIGINT) AS run, any_value(speaker) AS speaker, min("start") AS "start", arg_max("end", pos) AS "end", trim(string_agg(word, '' ORDER BY pos)) AS text FROM n GROUP BY session, run""")
def merge_words(spark, sf):
    """WIN-09."""
    s = seg_view(spark, sf).withColumn("speaker", F.when(F.col("speaker") == "Unknown", "click").otherwise(F.col("speaker")))
    return islands.merge_words(s.withColumns({"word": F.concat(F.lit(" w"), F.col("pos").cast("string")), "wordless": F.col("pos") % 9 == 0}))


@query(f"""WITH {SEG}, t AS (SELECT session, pos, speaker, "start", "end" FROM seg), k AS (SELECT session, pos, speaker, s + 0.6 AS a, s + 0.9 AS b, ("end" - "start" > 20) AS long, "start", "end" FROM (SELECT *, "start" AS s FROM t))
SELECT session, pos, CASE WHEN long THEN a ELSE "start" END AS "start", CASE WHEN long THEN b ELSE "end" END AS "end", CASE WHEN long THEN 'two' ELSE 'plain' END AS text FROM k WHERE CASE WHEN long THEN (a + b) / 2 >= 30 ELSE "end" > 30 END""")
def trim_prefix(spark, sf):
    """FLT-02: long segments have one late word, short ones none."""
    long = (F.col("end") - F.col("start")) > 20
    word = F.struct((F.col("start") + 0.6).alias("start"), (F.col("start") + 0.9).alias("end"), F.lit(" two").alias("word"))
    s = seg_view(spark, sf).withColumns({"text": F.lit("plain"), "words": F.when(long, F.array(word))})
    return segments.trim_prefix(s, 30.0).select("session", "pos", "start", "end", "text")


@query(f"WITH {SEG} SELECT session, pos, CASE WHEN pos % 5 = 0 THEN '[Calibrating]' WHEN speaker IN ('view', 'click') THEN 'SPEAKER_0' || CAST(length(speaker) - 4 AS VARCHAR) ELSE 'Unknown' END AS speaker FROM seg")
def relabel(spark, sf):
    """FLT-15 and JOI-11."""
    t = seg_view(spark, sf).withColumn("local", F.col("speaker"))
    mapping = t.where("local in ('view', 'click')").select("session", "local").distinct().withColumn("label", F.concat(F.lit("SPEAKER_0"), (F.length("local") - 4).cast("string")))
    return segments.relabel(t, mapping, ["session"], F.col("pos") % 5 == 0, F.lit("[Calibrating]")).select("session", "pos", "speaker")


@query(f"WITH {DECISIONS}, j AS (SELECT CASE WHEN seconds < 20 THEN 'low' WHEN seconds < 50 THEN 'middle' WHEN seconds < 90 THEN 'high' ELSE 'top' END AS band, mapped IS DISTINCT FROM reference AS w FROM de WHERE assigned IS NOT NULL AND assigned <> 'Unknown' AND reference IS NOT NULL) SELECT band, count(*) AS n, CAST(count_if(w) AS BIGINT) AS wrong, round(count_if(w) / count(*), 6) AS rate FROM j GROUP BY 1")
def band_error(spark, sf):
    """AGG-16."""
    return reports.banded(_decisions(spark, sf), "seconds", [20.0, 50.0, 90.0], ["low", "middle", "high", "top"]).withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, event_type, avg(floor(value)) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, NULL FROM events GROUP BY ALL HAVING count(*) FILTER (event_id % 3 <> 0) = 0")
def replicate_mean(spark, sf):
    """AGG-12: missing values (every third) don't count."""
    x = table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("double")).alias("value"))
    return reports.replicate_mean(x, ["user_id", "event_type"], ["value"])


@query("SELECT max(l_quantity) AS peak_l_quantity, max(l_discount) AS peak_l_discount, max(l_tax) AS peak_l_tax FROM lineitem")
def peaks(spark, sf):
    """AGG-22."""
    return reports.peaks(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT o_custkey, o_orderkey AS speaker, CAST(floor(o_totalprice / 6000) AS BIGINT) AS n_words FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 6000) DESC, o_orderkey) <= 8 OR floor(o_totalprice / 6000) >= 50")
def top_hypotheses(spark, sf):
    """SRT-04."""
    x = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("speaker"), F.floor(F.col("o_totalprice") / 6000).alias("n_words"))
    return reports.top_hypotheses(x, "o_custkey")


@query("""WITH r AS (SELECT c_nationkey AS k, c_name AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS n FROM (SELECT DISTINCT c_nationkey, c_name FROM customer)), h AS (SELECT s_nationkey AS k, s_name AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier))
SELECT k, n, r.s AS ref_speaker, h.s AS hyp_speaker FROM r FULL JOIN h USING (k, n)""")
def pad_pairs(spark, sf):
    """SET-04."""
    r = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("speaker")).distinct()
    h = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("speaker")).distinct()
    return intervals.pad_pairs(r, h, "k").select("k", F.col("n").cast("bigint").alias("n"), "ref_speaker", "hyp_speaker")


@query("SELECT coalesce(a.l, b.l) AS label, CASE WHEN a.l IS NOT NULL AND b.l IS NOT NULL THEN 'keep' WHEN a.l IS NOT NULL THEN 'add' ELSE 'remove' END AS action FROM (SELECT DISTINCT o_custkey AS l FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS l FROM orders WHERE o_orderstatus = 'O') b ON a.l = b.l")
def chip_diff(spark, sf):
    """SET-03."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("label"), "o_orderstatus")
    return intervals.chip_diff(o.where("o_orderstatus = 'F'").select("label"), o.where("o_orderstatus = 'O'").select("label"))


@query("SELECT p_brand, metric, b AS before, a AS after, a - b AS change FROM (SELECT p_brand, 'size' AS metric, avg(p_size) FILTER (p_partkey % 2 = 0) AS b, avg(p_size) FILTER (p_partkey % 2 = 1) AS a FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'price', avg(floor(p_retailprice)) FILTER (p_partkey % 2 = 0), avg(floor(p_retailprice)) FILTER (p_partkey % 2 = 1) FROM part GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def before_after(spark, sf):
    """SWP-05."""
    side = lambda k: table(spark, sf, "part").where(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg(F.floor("p_retailprice")).alias("price"))
    return reports.before_after(side(0), side(1), "p_brand", ["size", "price"])


@query("SELECT event_id, label, v AS score, label = 'a' AND event_id % 4 <> 0 AS same FROM (SELECT event_id, unnest(['a', 'b', 'c']) AS label, unnest([floor(value), floor(value) / 2, 1.0::DOUBLE]) AS v FROM events)")
def label_profiles(spark, sf):
    """JOI-16: profile a stands for the reference but for every fourth decision, b for none, c is unmapped."""
    v = F.floor("value").cast("double")
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, "R1").otherwise("R9").alias("reference"), F.create_map(F.lit("a"), v, F.lit("b"), v / 2, F.lit("c"), F.lit(1.0)).alias("raw_scores"))
    mapping = spark.createDataFrame([("a", "R1"), ("b", "R2")], "label string, mapped string")
    return intervals.label_profiles(d, mapping, ["event_id"]).select("event_id", "label", "score", "same")


@query("SELECT c.c_custkey AS k, o.n, l.q FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS ck, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1) l ON l.ck = c.c_custkey")
def score_rows(spark, sf):
    """JOI-12."""
    o = table(spark, sf, "orders")
    ref = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    hyp = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    q = table(spark, sf, "lineitem").join(o.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    return intervals.score_rows(ref, hyp, q, "k")


@query(f"WITH {SEG}, h AS (SELECT session, sum(\"end\" - \"start\") AS s FROM seg WHERE speaker <> 'Unknown' GROUP BY 1), s AS (SELECT session, max(\"end\") AS e FROM seg GROUP BY 1) SELECT session, round(coalesce(h.s, 0) / s.e, 6) AS coverage, round(0.25, 6) AS rtf FROM s LEFT JOIN h USING (session)")
def coverage(spark, sf):
    """MET-13."""
    s = seg_view(spark, sf)
    speech = s.groupBy("session").agg(F.max("end").alias("speech_seconds")).withColumns({"audio_seconds": F.col("speech_seconds"), "compute_seconds": F.col("speech_seconds") / 4})
    return reports.coverage(speech, s.where("speaker <> 'Unknown'"), "session").select("session", F.round("coverage", 6).alias("coverage"), F.round("rtf", 6).alias("rtf"))


@query(f"WITH {PAIRS}, v AS (SELECT score AS p, count(*) AS n, sum(CAST(NOT same AS INTEGER)) AS w FROM pr GROUP BY ALL), x AS (SELECT p, sum(w) OVER o / sum(n) OVER o AS rate, sum(n) OVER o AS c, sum(n) OVER () AS t FROM v WINDOW o AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), c AS (SELECT target, min(p) AS p, max(c) / max(t) AS cov FROM x, (SELECT unnest([0.3, 0.2, 0.05]::DOUBLE[]) AS target) WHERE rate <= target GROUP BY target) SELECT max(p) FILTER (target = 0.05) AS assign, max(p) FILTER (cov >= 0.1) AS learn, 0.6::DOUBLE AS new_speaker FROM c")
def policy_from_cuts(spark, sf):
    """NUM-09."""
    rows = _pairs(spark, sf).select(F.col("score").alias("p"), (~F.col("same")).alias("wrong"))
    return calibration.policy_from_cuts(calibration.cut_points(rows, (0.3, 0.2, 0.05)))


def _signal(n):
    """A rising saw of so many 16-bit samples."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: (x * 37 % 2000 - 1000).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))


SIGNAL = "list_transform(range(0, {0}), lambda x: CAST(x * 37 % 2000 - 1000 AS SMALLINT))"


@query(f"SELECT doc_id, i AS frame, c[i * 480 + 1] AS first, CAST(480 AS BIGINT) AS n FROM (SELECT doc_id, {SIGNAL.format('n_chars')} AS c, unnest(range(0, n_chars // 480)) AS i FROM documents)")
def pcm_frames(spark, sf):
    """SRC-04: a signal as long as the document in frames of 30 ms."""
    from ..operators.speech import frames

    d = table(spark, sf, "documents").select("doc_id", _signal(F.col("n_chars").cast("int")).alias("pcm"))
    return frames(d, "pcm", 480, keep=("doc_id",)).select("doc_id", F.col("frame").cast("bigint").alias("frame"), F.element_at("samples", 1).alias("first"), F.size("samples").cast("bigint").alias("n"))


@query(f"WITH {SEG}, g AS (SELECT session, pos, speaker, \"end\" - \"start\" AS d, limit_ FROM seg, (SELECT unnest([5.005, 20.005, 60.005]::DOUBLE[]) AS limit_)) SELECT limit_ AS small_seconds, count(*) FILTER (d <= limit_) AS n_short, count(DISTINCT session) FILTER (d <= limit_) AS n_sessions FROM g GROUP BY 1")
def sweep_grid(spark, sf):
    """SWP-01: configurations as an array in each row; one pass for all of them."""
    s = seg_view(spark, sf).withColumn("d", F.col("end") - F.col("start")).withColumn("small_seconds", F.explode(F.array(*[F.lit(x) for x in (5.005, 20.005, 60.005)])))
    hit = F.col("d") <= F.col("small_seconds")
    return s.groupBy("small_seconds").agg(F.count_if(hit).alias("n_short"), F.count_distinct(F.when(hit, F.col("session"))).alias("n_sessions"))


@query("SELECT conv_id || '' AS meeting, \"start\", \"start\" + d AS \"end\", speaker FROM (SELECT conv_id, turn / 2.0::DOUBLE AS \"start\", turn % 3 AS d, role AS speaker FROM conversations) WHERE d > 0")
def rttm_intervals(spark, sf):
    """SRC-06 over lines made of conversations."""
    from ..sources.readers import intervals as parse

    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("conv_id").cast("string"), F.lit("1"), (F.col("turn") / 2).cast("string"), (F.col("turn") % 3).cast("string"), F.lit("<NA>"), F.lit("<NA>"), F.col("role"), F.lit("<NA>"), F.lit("<NA>"))
    return parse(table(spark, sf, "conversations").select(line.alias("value")))


@query("SELECT id, arg_max(t, n) AS text FROM (SELECT 'u' || CAST(event_id % 500 AS VARCHAR) AS id, event_type || ' ' || CAST(event_id AS VARCHAR) AS t, event_id AS n FROM events) GROUP BY 1")
def utterances(spark, sf):
    """SRC-13: the last of equal ids stays."""
    from ..sources.readers import utterances as parse

    i = F.col("event_id")
    return parse(table(spark, sf, "events").select(F.concat(F.lit("u"), (i % 500).cast("string"), F.lit(" "), F.col("event_type"), F.lit(" "), i.cast("string")).alias("value"), i.alias("line_no")))


@query("SELECT conv_id AS key, string_agg('[' || role || '] ' || printf('%.1f', turn / 4.0::DOUBLE) || 's - ' || printf('%.1f', turn / 4.0::DOUBLE + 1.5) || 's: ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def transcript_lines(spark, sf):
    """SNK-13: quarter seconds show the rounding to even."""
    from ..sources.writers import transcript_lines as lines

    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), (F.col("turn") / 4.0).alias("start"), (F.col("turn") / 4.0 + 1.5).alias("end"), "text")
    return lines(s, "key")


@query("SELECT page_id, CAST(len(list_distinct(list_filter(string_split(regexp_replace(html, '[^a-z]', ' ', 'g'), ' '), lambda x: x <> ''))) AS BIGINT) AS n_distinct FROM pages")
def distinct_tokens(spark, sf):
    """STR-03 over markup."""
    t = text.words(F.regexp_replace("html", "[^a-z]", " "))
    return table(spark, sf, "pages").select("page_id", F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def _marked() -> Callable:
    """A stand-in for a translation model."""
    return lambda p: p.assign(translation="T:" + p["text"])


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang AS source, 'en-GB' AS target FROM documents), c AS (SELECT DISTINCT text, source, target FROM d WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN source = 'en' THEN d.text WHEN trim(d.text) = '' THEN '' WHEN c.text IS NOT NULL THEN 'cached' ELSE 'T:' || d.text END AS translation FROM d LEFT JOIN c USING (text, source, target)""")
def translate_cached(spark, sf):
    """UDF-04 to UDF-06 with a stand-in model; what a third of the documents holds is known already."""
    from ..operators.speech import translate

    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("source"), F.lit("en-GB").alias("target"))
    cache = d.where("doc_id % 3 = 0").select("text", "source", "target").distinct().withColumn("translation", F.lit("cached"))
    return translate(d, cache, _marked).select("doc_id", "translation")


MISLED = "CASE WHEN pos % 7 = 3 THEN 'S9' ELSE 'S' || CAST(length(speaker) AS VARCHAR) END"


@query(f"""WITH RECURSIVE {CONV}, fl AS (SELECT session, string_agg(trim(text), ' ' ORDER BY "start", pos) AS t FROM conv GROUP BY 1), fw AS (SELECT session, {_words_sql('t')} AS r, {_words_sql('t')} AS h FROM fl), {distances_sql('fe', 'fw', 'session')}, {cpwer_sql(MISLED)},
rf AS (SELECT session AS m, "start" AS a, "end" AS b, speaker AS s FROM conv WHERE "end" > "start"), hy AS (SELECT session AS m, "start" AS a, "end" AS b, {MISLED} AS s FROM conv WHERE "end" > "start"), {der_sql('rf', 'hy', 0)}
SELECT fe.session, fe.n_words, fe.errors, round(fe.errors / fe.n_words, 6) AS wer, round(cp.errors / cp.n_words, 6) AS cpwer, abs(round((fa + mi + co) / greatest(total, 1e-8), 6)) AS der FROM fe LEFT JOIN cp USING (session) LEFT JOIN dr ON dr.m = fe.session""")
def session_report(spark, sf):
    """MET-14: turns against the same turns with every seventh misattributed."""
    from ..operators import services

    c = conv_view(spark, sf)
    h = c.withColumn("speaker", F.when(F.col("pos") % 7 == 3, "S9").otherwise(F.concat(F.lit("S"), F.length("speaker").cast("string"))))
    return services.session_report(c, h).withColumns({x: F.abs(F.round(x, 6)) for x in ("wer", "cpwer", "der")})


@query(f"WITH {SCORES_SQL} SELECT round(bleu.v, 6) AS bleu, round(chrf.v, 6) AS chrf, NULL::DOUBLE AS neural FROM bleu, chrf")
def translation_report(spark, sf):
    from ..operators import services

    return services.translation_report(_texts(spark, sf).withColumn("source", F.lit("")), "item_id").select(F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"), "neural")
