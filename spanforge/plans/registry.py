"""Registered queries: each operator over the driver tables, with its SQL twin.

Stand-ins: a user or an order is a video, an event or a shipping window a span, a
conversation turn a caption, labels are verdicts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains, json_text, spans, text
from ..operators import evals, intervals, quality, ranking, similarity, stages, stats
from ..sources.model import FakeClient
from .session import ship

FLAGSHIP = "iou_by_type"
_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir, f=f: f(lambda name: ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _day(c: str):
    return F.unix_date(F.col(c).cast("date"))


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _orders(t):
    return t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("kind"), _day("o_orderdate").alias("g_start"), (_day("o_orderdate") + 30).alias("g_end"))


def _lines(t):
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + 10).alias("end"))


_DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
_O = f"(SELECT o_orderkey AS k, o_orderpriority AS kind, {_DAY.format('o_orderdate')} AS gs, {_DAY.format('o_orderdate')} + 30 AS ge FROM orders)"
_L = f"(SELECT l_orderkey AS k, l_linenumber AS line, {_DAY.format('l_shipdate')} AS s, {_DAY.format('l_shipdate')} + 10 AS e FROM lineitem)"
_IOU = "CASE WHEN s IS NOT NULL THEN greatest(0, least(ge, e) - greatest(gs, s))::DOUBLE / (greatest(ge, e) - least(gs, s)) END"
_SCORED = f"(SELECT o.k, kind, gs, ge, s, e, coalesce({_IOU}, 0.0) AS iou, s IS NULL AS missing FROM {_O} o LEFT JOIN (SELECT k, min(s) AS s, min(e) AS e FROM {_L} GROUP BY k) l ON o.k = l.k)"
_SCORES = "count(*) AS n, round(avg(iou), 6) AS miou, avg(missing::INT::DOUBLE) AS parse_fail, avg((iou >= 0.3)::INT::DOUBLE) AS r_at_3, avg((iou >= 0.5)::INT::DOUBLE) AS r_at_5, avg((iou >= 0.7)::INT::DOUBLE) AS r_at_7"


def _scored(t):
    pred = _lines(t).groupBy("k").agg(F.min("start").alias("s"), F.min("end").alias("e"))
    rows = evals.grounded(_orders(t), pred, "k", "s", "e")
    return rows.withColumn("iou", spans.iou(F.col("g_start"), F.col("g_end"), F.col("p_start"), F.col("p_end"))).withColumn("missing", F.col("p_start").isNull())


@query(f"SELECT kind, {_SCORES} FROM {_SCORED} GROUP BY ROLLUP (kind)")
def iou_by_type(t):
    return evals.scores(_scored(t), "kind")


@query(f"SELECT {_SCORES} FROM {_SCORED}")
def iou_summary(t):
    return _scored(t).agg(*evals.score_columns(F.col("iou"), F.col("missing")))


@query(f"SELECT k, round(iou, 9) AS iou, missing FROM {_SCORED}")
def iou_per_row(t):
    return _scored(t).select("k", F.round("iou", 9).alias("iou"), "missing")


@query(f"SELECT CASE WHEN ge - gs + k % 200 <= 60 THEN 'short' WHEN ge - gs + k % 200 > 150 THEN 'long' ELSE 'mid' END AS bucket, {_SCORES} FROM {_SCORED} GROUP BY 1")
def length_buckets(t):
    rows = _scored(t).withColumn("bucket", evals.length_bucket(F.col("g_end") - F.col("g_start") + F.col("k") % 200))
    return rows.groupBy("bucket").agg(*evals.score_columns(F.col("iou"), F.col("missing")))


_WIDE = "CASE WHEN s IS NOT NULL THEN greatest(0, least(ge, e + 3) - greatest(gs, s - 3))::DOUBLE / (greatest(ge, e + 3) - least(gs, s - 3)) END"


@query(f"SELECT round(avg(iou), 6) AS miou_a, round(avg(b), 6) AS miou_b, count(*) FILTER (WHERE iou >= 0.5) AS hit_a, count(*) FILTER (WHERE b >= 0.5) AS hit_b, count(*) FILTER (WHERE b > iou + 0.02) AS better, count(*) FILTER (WHERE b < iou - 0.02) AS worse FROM (SELECT iou, coalesce({_WIDE}, 0.0) AS b FROM {_SCORED})")
def widening_compared(t):
    s, e = evals.widened(F.col("p_start"), F.col("p_end"), F.lit(10**9), 3)
    return evals.compared(_scored(t).select(F.col("iou").alias("a"), spans.iou(F.col("g_start"), F.col("g_end"), s, e).alias("b")))


@query(f"SELECT kind, round(avg(greatest(0, least(ge - gs, 0.3::DOUBLE * 100) - (k % 20)) / (greatest(ge - gs + k % 20, 30) - 0)), 4) AS miou FROM (SELECT k, kind, 0 AS gs, 30 AS ge FROM {_O}) GROUP BY kind")
def front_prior(t):
    s, e = evals.front_prior(F.lit(100.0))
    o = _orders(t).withColumns({"a": F.col("k") % 20, "b": F.col("k") % 20 + 30})
    return o.groupBy("kind").agg(F.round(F.avg(spans.iou(F.col("a").cast("double"), F.col("b").cast("double"), s, e)), 4).alias("miou"))


_US = "epoch_us(ts)"


@query(
    f"""WITH a AS (SELECT user_id, event_id, event_type, {_US} AS s, {_US} + 3600000000 * (1 + event_id % 5) AS e FROM events),
b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id, run ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM r),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm + 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
SELECT user_id, island::INT AS island, min(s) AS "start", max(e) AS "end", min_by(event_type, s) AS label, string_agg('e' || event_id, ' ' ORDER BY s, event_id) AS description, count(*) AS n FROM i GROUP BY user_id, island"""
)
def event_islands(t):
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("label"), _micros("ts").alias("start"))
    e = e.withColumns({"end": F.col("start") + F.lit(3_600_000_000) * (1 + F.col("event_id") % 5), "pos": F.struct("start", "event_id"), "description": F.concat(F.lit("e"), "event_id"), "evidence": F.array("label"), "confidence": F.lit("high"), "evidence_strength": F.lit("clear")})
    rows = intervals.islands(e, "user_id", "start", "end", ["start", "event_id"], [F.col("label")], F.lit(43_200_000_000))
    rows = rows.withColumn("pos", F.row_number().over(_w("user_id", "island", "start", "event_id")))
    return intervals.fold_events(rows, "user_id").select("user_id", "island", "start", "end", "label", "description", "n")


def _w(*by):
    from pyspark.sql import Window

    return Window.partitionBy(*by[:-2]).orderBy(*by[-2:])


@query(f"SELECT o.k, line, gs, s FROM {_O} o JOIN {_L} l ON o.k = l.k AND s < ge AND e > gs")
def interval_overlap_join(t):
    j = intervals.overlap_join(_orders(t), _lines(t), "k", ("g_start", "g_end"), ("start", "end"))
    return j.select("k", "line", F.col("g_start").alias("gs"), F.col("start").alias("s"))


@query(f"SELECT o.k, gs AS \"start\", ge AS \"end\", coalesce(string_agg(line::VARCHAR, ',' ORDER BY line), '') AS ids FROM {_O} o LEFT JOIN {_L} l ON o.k = l.k AND s < ge AND e > gs GROUP BY o.k, gs, ge")
def interval_left_resolve(t):
    items = _orders(t).select("k", F.lit(0).alias("q"), F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    segs = _lines(t).select("k", F.col("line").cast("string").alias("segment_id"), F.col("line").alias("index"), F.col("start").alias("start_time"), F.col("end").alias("end_time"))
    return intervals.resolved(items, segs, "k", "q", True).select("k", "start", "end", F.array_join("segment_ids", ",").alias("ids"))


def _grid_sql(w, s):
    d = "(c_custkey % 97)::DOUBLE / 2"
    return f"""WITH v AS (SELECT c_custkey AS video_id, {d} AS d FROM customer),
n AS (SELECT *, CASE WHEN d + 1e-6 >= {w} THEN floor((d + 1e-6 - {w}) / {s})::BIGINT + 1 ELSE 0 END AS nf FROM v),
g AS (SELECT *, unnest(range(0, nf + CASE WHEN nf * {s} < d - 1e-6 THEN 1 ELSE 0 END)) AS i FROM n)
SELECT video_id, format('s{{:03d}}', i + 1) AS segment_id, i::INT AS "index", i * {s}::DOUBLE AS start_time, least(i * {s} + {w}, d)::DOUBLE AS end_time FROM g WHERE least(i * {s} + {w}, d) - i * {s} >= 1"""


def _videos(t):
    return t("customer").select(F.col("c_custkey").alias("video_id"), ((F.col("c_custkey") % 97) / 2.0).alias("duration"))


@query(_grid_sql(5, 5))
def grid_windows(t):
    return spans.plan_segments(_videos(t), 5, 5)


@query(_grid_sql(5, 2.5))
def grid_overlapping(t):
    return spans.plan_segments(_videos(t), 5, 2.5)


@query(f"WITH g AS ({_grid_sql(5, 2.5)}), a AS (SELECT video_id, max(end_time - start_time) AS w, max(start_time) FILTER (WHERE \"index\" = 1) AS s FROM g GROUP BY video_id) SELECT video_id, format('win{{:.2f}}_str{{:.2f}}', w, coalesce(s, w)) AS grid_key FROM a")
def grid_key(t):
    return spans.grid_key_of(spans.plan_segments(_videos(t), 5, 2.5))


@query("SELECT c_custkey AS video_id, p * 8.0::DOUBLE AS \"start\", least(12.0, (c_custkey % 97) - p * 8.0)::DOUBLE AS length FROM (SELECT c_custkey, unnest(range(0, greatest(ceil((c_custkey % 97) / 8.0)::BIGINT, 1))) AS p FROM customer) WHERE least(12.0, (c_custkey % 97) - p * 8.0) >= 3")
def scan_windows(t):
    v = t("customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") % 97).cast("double").alias("d"))
    return v.select("video_id", F.inline(spans.scan_windows(F.col("d"), 12.0, 8.0)))


@query(f"WITH a AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_L}), b AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT k, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n FROM b GROUP BY k, g")
def span_union(t):
    return intervals.span_union(_lines(t), "k")


@query(f"WITH a AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY s, e) AS m FROM (SELECT k, s, s + 5 + line * 7 AS e FROM {_L})), b AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT k, g, min(s) AS s, max(e) AS e, count(*) AS n FROM b GROUP BY k, g) SELECT k, s AS \"start\", e AS \"end\", n AS support FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, e - s DESC, g) = 1")
def cluster_vote(t):
    return intervals.cluster_vote(_lines(t).withColumn("end", F.col("start") + 5 + F.col("line") * 7), "k")


_CELL = """(SELECT l_orderkey AS k, l_linenumber AS line, (l_partkey % 100)::DOUBLE / 2 AS s, (l_partkey % 100)::DOUBLE / 2 + 1 + l_suppkey % 17 AS e FROM lineitem)"""
_CELLS = "list_filter(range(least(floor(s / 5)::BIGINT, 13), greatest(least(floor(s / 5)::BIGINT, 13), least(ceil(e / 5)::BIGINT - 1, 13)) + 1), lambda i: greatest(0, least(e, (i + 1) * 5) - greatest(s, i * 5)) >= least(5, e - s) / 2)"
_CELL_IDS = f"CASE WHEN len({_CELLS}) > 0 THEN {_CELLS} ELSE [least(floor(s / 5)::BIGINT, 13)] END"


def _cell_rows(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), ((F.col("l_partkey") % 100).cast("double") / 2).alias("s"), (F.col("l_suppkey") % 17).alias("x"))
    c = c.withColumn("e", F.col("s") + 1 + F.col("x"))
    return c.select("k", "line", spans.cells(F.col("s"), F.col("e"), F.lit(70.0)).alias("cells"))


@query(f"SELECT k, line, array_to_string({_CELL_IDS}, ',') AS cells FROM {_CELL}")
def grid_cells(t):
    return _cell_rows(t).select("k", "line", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))


@query(f"WITH c AS (SELECT k, line, {_CELL_IDS} AS c FROM {_CELL}) SELECT a.k, round(len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))), 6) AS j FROM c a JOIN c b ON a.k = b.k AND a.line = 1 AND b.line = 2")
def grid_jaccard(t):
    c = _cell_rows(t)
    a, b = c.where("line = 1").select("k", F.col("cells").alias("a")), c.where("line = 2").select("k", F.col("cells").alias("b"))
    return a.join(b, "k").select("k", F.round(spans.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN 'accepted' ELSE 'discarded' END AS st FROM events) SELECT user_id, event_id, CASE WHEN st = 'accepted' AND row_number() OVER (PARTITION BY user_id, st ORDER BY event_id::VARCHAR) > 8 THEN 'discarded' ELSE st END AS final_status FROM a")
def accepted_cap_per_video(t):
    e = t("events").select("user_id", "event_id", F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), "accepted").otherwise("discarded").alias("final_status"))
    return ranking.capped(e, "user_id", [F.col("event_id").cast("string")], 8)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def head_segments(t):
    return ranking.head_per_group(t("events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id")


@query("SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) ORDER BY rn, conv_id LIMIT 100")
def round_robin_sample(t):
    return ranking.round_robin(t("conversations").dropDuplicates(["conv_id", "turn"]), "conv_id", ["turn"], 100).select("conv_id", "turn", F.col("rn").cast("long").alias("rn"))


@query("SELECT conv_id, role, max(turn) - min(turn) + 1 = count(DISTINCT turn) AS whole FROM conversations GROUP BY conv_id, role")
def consecutive_span(t):
    return t("conversations").groupBy("conv_id", "role").agg(ranking.consecutive("turn").alias("whole"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS chunk FROM conversations")
def chunk_ids(t):
    return ranking.chunked(t("conversations").select("conv_id", "turn"), "conv_id", ["turn"], 4)


@query("SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'needed' ELSE 'pending' END AS part FROM events")
def resume_anti_join(t):
    e = t("events").select("event_id", "user_id", "event_type")
    done = e.where("event_type = 'purchase'")
    parts = ((ranking.pending, "pending"), (ranking.needed, "needed"))
    a, b = (f(e, done, ["user_id"]).select("event_id", F.lit(name).alias("part")) for f, name in parts)
    return a.unionByName(b)


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND l.quality = 1) AS hits, count(*) FILTER (WHERE l.doc_id IS NULL OR l.quality = 0) AS todo FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_hits_and_todo(t):
    hit, todo = ranking.cache_split(t("documents").select("doc_id"), t("labels").withColumn("ok", F.col("quality") == 1), ["doc_id"], "ok")
    return hit.agg(F.count(F.lit(1)).alias("hits")).crossJoin(todo.agg(F.count(F.lit(1)).alias("todo")))


@query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def first_wins(t):
    return ranking.first_wins(t("documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("SELECT doc_id, q FROM (SELECT doc_id, quality AS q, 1 AS src FROM labels UNION ALL SELECT doc_id, -1 AS q, 0 AS src FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src DESC) = 1")
def last_wins_merge(t):
    return ranking.merged_runs([t("documents").select("doc_id", F.lit(-1).alias("q")), t("labels").select("doc_id", F.col("quality").alias("q"))], ["doc_id"])


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'revise' END AS decision, '' AS reason FROM labels UNION ALL SELECT doc_id, 'fail', 'no verdict' FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def missing_verdict_fail(t):
    v = t("labels").select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("revise").alias("decision"), F.lit("").alias("reason"))
    return ranking.with_missing(v, t("documents"), ["doc_id"], decision="fail", reason="no verdict")


@query("SELECT doc_id, CASE WHEN NOT (toxic = 0 AND doc_id % 11 <> 0) THEN 'fail' WHEN quality = 0 THEN 'revise' ELSE 'pass' END AS decision FROM labels")
def decision_rule(t):
    return t("labels").select("doc_id", json_text.decision(F.col("toxic") == 0, F.col("doc_id") % 11 != 0, F.col("quality") == 1).alias("decision"))


_GP = "(SELECT quality = 1 AS g, n_chars > 1500 AS p, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' ELSE 'revise' END AS gd, CASE WHEN n_chars > 1500 THEN 'pass' WHEN n_chars > 600 THEN 'revise' ELSE 'fail' END AS pd FROM labels JOIN documents USING (doc_id))"


def _judged(t):
    j = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    return j.select((F.col("quality") == 1).alias("g"), (n > 1500).alias("p"), F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("revise").alias("gd"), F.when(n > 1500, "pass").when(n > 600, "revise").otherwise("fail").alias("pd"))


@query(f"WITH c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM {_GP}) SELECT tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def verdict_prf(t):
    return _judged(t).agg(*evals.prf(F.col("g"), F.col("p")))


@query(f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE gd = pd) AS ok, count(*) FILTER (WHERE gd = 'pass' AND pd = 'pass') AS tp, count(*) FILTER (WHERE gd <> 'pass' AND pd = 'pass') AS fp, count(*) FILTER (WHERE gd = 'pass' AND pd <> 'pass') AS fn, count(*) FILTER (WHERE gd <> 'pass') AS ng FROM {_GP}) SELECT n, round(ok::DOUBLE / n, 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS accept_f1, round(fp::DOUBLE / ng, 6) AS false_pass FROM c")
def decision_metrics(t):
    return evals.decision_metrics(_judged(t), "gd", "pd")


_JUDGE = "(SELECT event_type AS grp, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 + 1 END AS faithfulness, CASE WHEN event_id % 4 <> 0 THEN event_id % 4 + 2 END AS hallucination, CASE WHEN event_type <> 'click' THEN event_id % 5 + 1 END AS coverage, 3 + event_id % 2 AS fluency FROM events)"
_MEANS = " UNION ALL ".join(f"SELECT grp, '{d}' AS dim, round(avg({d}), 6) AS mean, count({d}) AS n FROM {_JUDGE} GROUP BY grp" for d in domains.CAPTION_WEIGHTS)


def _judge(t):
    i = F.col("event_id")
    e = t("events").select(F.col("event_type").alias("grp"), F.when(i % 3 != 0, i % 5 + 1).alias("faithfulness"), F.when(i % 4 != 0, i % 4 + 2).alias("hallucination"), F.when(F.col("event_type") != "click", i % 5 + 1).alias("coverage"), (3 + i % 2).alias("fluency"))
    return evals.judge_means(e, list(domains.CAPTION_WEIGHTS), "grp")


@query(_MEANS)
def judge_dim_means(t):
    return _judge(t)


@query(f"WITH m AS ({_MEANS}), w AS (SELECT *, CASE dim WHEN 'faithfulness' THEN 0.3::DOUBLE WHEN 'hallucination' THEN 0.35::DOUBLE WHEN 'coverage' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS w FROM m WHERE mean IS NOT NULL) SELECT grp, round(sum(w * mean) / sum(w), 6) AS combined FROM w GROUP BY grp")
def judge_combined(t):
    return evals.combined_score(_judge(t), "grp")


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM events GROUP BY event_type")
def label_distribution(t):
    return stats.histogram(t("events"), "event_type")


@query("SELECT l_returnflag AS stage, count(*) AS calls, sum(l_linenumber)::BIGINT AS l_linenumber, sum((l_quantity * 100)::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def usage_rollup(t):
    return stats.usage(t("lineitem").select(F.col("l_returnflag").alias("stage"), "l_linenumber", (F.col("l_quantity") * 100).cast("long").alias("tokens")), "stage", ["l_linenumber", "tokens"])


_NORM = "trim(regexp_replace(translate(lower(text), '{p}', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))".format(p=text.PUNCTUATION.replace("'", "''"))


@query(f"SELECT array_to_string(string_split({_NORM}, ' ')[1:2], ' ') AS phrase, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY 1 HAVING count(*) > 3")
def leading_phrase_repeats(t):
    return t("documents").withColumn("text", F.coalesce("text", F.lit(""))).groupBy(text.leading_phrase(F.col("text")).alias("phrase")).agg(F.count(F.lit(1)).alias("n")).where("n > 3")


_SETS = f"(SELECT conv_id, turn, list_distinct(string_split({_NORM}, ' ')) AS w FROM conversations WHERE length({_NORM}) > 0)"


@query(f"SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)), 6) AS overlap FROM {_SETS} a JOIN {_SETS} b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)) >= 0.2")
def word_overlap_pairs(t):
    return quality.all_similar_pairs(t("conversations"), "conv_id", "turn", "text", 0.2).select("conv_id", "a", "b", F.round("overlap", 6).alias("overlap"))


_MOOD = "array['a happy, low voice', 'She sighs, clearly expressing sadness and anger; then', 'a sad, high pitch and', 'no cue', 'very tense and', 'An upset, ALARMED crowd, showing some fear']"


@query()  # SQL's engine has ASCII word boundaries only: tested against Python's
def emotion_scrub(t):
    d = t("documents").select("doc_id", F.expr(f"element_at({_MOOD.replace('[', '(').replace(']', ')')}, cast(doc_id % 6 + 1 as int)) || ' ' || text").alias("x"))
    return d.select("doc_id", text.scrubbed(F.col("x")).alias("clean"))


def _word_sql(x, words):
    return f"regexp_matches(lower({x}), '\\b(?:{domains.alternation(words)})\\b')"


@query(f"WITH a AS (SELECT doc_id, ({_MOOD.replace('array', '')})[doc_id % 6 + 1] AS o, ({_MOOD.replace('array', '')})[doc_id % 5 + 1] AS n FROM documents) SELECT doc_id, ({_word_sql('o', domains.EMOTION_WORDS)} AND NOT {_word_sql('n', domains.EMOTION_WORDS)}) OR {_word_sql('n', domains.FORBIDDEN_WORDS)} AS back FROM a")
def guardrail_words(t):
    pick = lambda m: F.expr(f"element_at({_MOOD.replace('[', '(').replace(']', ')')}, cast(doc_id % {m} + 1 as int))")
    return t("documents").select("doc_id", text.guardrail_reverts(pick(6), pick(5)).alias("back"))


@query("WITH a AS (SELECT event_id, event_id % 6 AS m, event_id % 90 AS x, user_id % 90 AS y FROM events) SELECT event_id, CASE WHEN m = 5 OR x = y THEN NULL ELSE least(x, y)::VARCHAR || '-' || greatest(x, y) END AS span FROM a WHERE m IN (0, 2, 5) UNION ALL SELECT event_id, CASE WHEN 60 * (x % 9) + x % 60 = 60 * (y % 9) + y % 60 THEN NULL ELSE least(60 * (x % 9) + x % 60, 60 * (y % 9) + y % 60)::VARCHAR || '-' || greatest(60 * (x % 9) + x % 60, 60 * (y % 9) + y % 60) END FROM a WHERE m = 3 UNION ALL SELECT event_id, NULL FROM a WHERE m IN (1, 4)")
def parse_span(t):
    e = t("events").select("event_id", (F.col("event_id") % 6).alias("m"), (F.col("event_id") % 90).alias("x"), (F.col("user_id") % 90).alias("y"))
    m, x, y = F.col("m"), F.col("x"), F.col("y")
    clock = lambda v: F.format_string("%d:%02d", v % 9, v % 60)
    reply = (
        F.when(m == 0, F.format_string("from %d seconds to %d seconds, 3 then 4", x, y))
        .when(m == 1, F.format_string("%d to %d seconds but 1 and 9", x, x))
        .when(m == 2, F.format_string("It is %d then %d", x, y))
        .when(m == 3, F.concat(F.lit("between "), clock(x), F.lit(" or "), clock(y)))
        .when(m == 4, F.concat(F.lit("at "), clock(x)))
        .otherwise("nowhere")
    )
    s = text.time_span(reply)
    return e.select("event_id", F.concat_ws("-", s[0].cast("long"), s[1].cast("long")).alias("span"), s.isNotNull().alias("ok")).select("event_id", F.when(F.col("ok"), F.col("span")).alias("span"))


@query("SELECT event_id, least(event_id % 9, user_id % 9) * 5.0::DOUBLE AS s, least((greatest(event_id % 9, user_id % 9) + 1) * 5.0::DOUBLE, 42.5) AS e FROM events")
def parse_segment_ids(t):
    s = text.segment_span(F.format_string("segments: s%03d, s%03d.", F.col("event_id") % 9, F.col("user_id") % 9), F.lit(42.5))
    return t("events").select("event_id", s[0].alias("s"), s[1].alias("e"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_noisy(t):
    reply = F.concat(F.lit("<think>{\"k\": -1}</think> Sure:\n```json\nresult "), "props", F.lit(" and more } text\n```\nbye"))
    return t("events").select("event_id", F.from_json(json_text.first_object(reply), "k long")["k"].alias("k"))


@query("SELECT event_id, event_id % 5 = 0 AS ok, CASE WHEN event_id % 5 IN (0, 4) THEN '' ELSE 'invalid format' END AS reason FROM events")
def json_bool_strict(t):
    reply = F.element_at(F.array(*[F.lit(x) for x in ('{"x":true}', '{"x":"true"}', '{"x":1}', "{}", '{"x":false}')]), (F.col("event_id") % 5 + 1).cast("int"))
    v = json_text.verdict(reply, "x")
    return t("events").select("event_id", json_text.strict_true(reply, "x").alias("ok"), v["reason"].alias("reason"))


@query("SELECT event_id, [4, 4, 1, NULL, NULL, NULL, 5][event_id % 7 + 1] AS score FROM events")
def score_range_check(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ('"4"', "4.7", "true", '"4.7"', "9", "null", "5")]), (F.col("event_id") % 7 + 1).cast("int"))
    return t("events").select("event_id", json_text.score(raw).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Visual: ' || trim(text, ' ') WHEN turn % 3 = 1 THEN 'Audio: ' || trim(role, ' ') ELSE 'Visual: ' || trim(text, ' ') || chr(10) || 'Audio: ' || trim(role, ' ') END AS payload FROM conversations WHERE length(trim(text, ' ')) > 0")
def payload_render(t):
    p = text.payload(F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")), F.when(F.col("turn") % 3 != 0, F.col("role")))
    return t("conversations").where("length(trim(text)) > 0").select("conv_id", "turn", p.alias("payload"))


def _turns(t, *also):
    return t("conversations").select("conv_id", *also, F.col("turn").alias("index"), F.format_string("s%03d", F.col("turn")).alias("segment_id")).distinct()


@query("WITH s AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM s), q AS (SELECT conv_id, min(rk) AS lo, max(rk) AS hi FROM r WHERE turn IN (1, 2) GROUP BY conv_id) SELECT r.conv_id, string_agg(format('s{:03d}', turn), ',' ORDER BY rk) AS ids FROM r JOIN q ON q.conv_id = r.conv_id AND rk BETWEEN lo - 2 AND hi + 2 GROUP BY r.conv_id")
def candidate_band(t):
    s = _turns(t)
    q = s.where("index in (1, 2)").groupBy("conv_id").agg(F.collect_list("segment_id").alias("segment_ids")).withColumn("query_id", F.lit(1))
    return intervals.candidate_band(q, s, "conv_id", 2).select("conv_id", F.array_join("candidates", ",").alias("ids"))


@query("SELECT conv_id, role, count(*) > 0 AND max(turn) - min(turn) + 1 = count(*) AND min(turn) >= 1 AS ok FROM (SELECT DISTINCT conv_id, role, turn FROM conversations) GROUP BY conv_id, role")
def contiguity_check(t):
    s = _turns(t, "role").groupBy("conv_id", "role").agg(F.collect_list("segment_id").alias("c"), F.collect_list("index").alias("i"))
    # each conversation's own turns, but for turn 0
    allowed = _turns(t).groupBy("conv_id").agg(F.collect_list(F.when(F.col("index") >= 1, F.col("segment_id"))).alias("allowed"))
    return s.join(allowed.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "role", intervals.valid_selection(F.col("c"), F.col("i"), F.col("allowed")).alias("ok"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT * FROM conversations WHERE role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY conv_id")
def looked_up_values(t):
    c = t("conversations")
    items = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    got = ranking.looked_up(items, ["conv_id"], "turns", c.where("role <> 'user'"), "turn", "role", 3)
    return got.where("size(roles) > 0").select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT (SELECT count(*) FROM lineitem) AS segments, (SELECT count(*) FROM conversations) AS raw_captions, (SELECT count(*) FROM events) AS emotion_events, (SELECT count(*) FROM documents) AS initial_queries, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS discarded, count(DISTINCT doc_id % 50) AS videos, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(DISTINCT doc_id % 50), 4) AS accepted_per_video, round(count(*) FILTER (WHERE toxic = 0 AND doc_id % 2 = 0)::DOUBLE / count(*) FILTER (WHERE doc_id % 2 = 0), 4) AS first_pass_rate, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / (SELECT count(*) FROM documents), 4) AS acceptance_rate, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS emotions, (SELECT string_agg(lang || ':' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)) AS initial_types, (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT 't' || doc_id % 3 AS k, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1)) AS accepted_types, (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT doc_id % 4 AS k, count(*) AS n FROM labels GROUP BY 1)) AS rewrites FROM labels")
def stats_row(t):
    lab = t("labels")
    traces = lab.select((F.col("doc_id") % 50).alias("video_id"), F.when(F.col("quality") == 1, "accepted").otherwise("discarded").alias("final_status"), F.concat(F.lit("t"), F.col("doc_id") % 3).alias("query_type"), (F.col("doc_id") % 4).alias("rewrite_count"))
    verdicts = lab.select((F.col("doc_id") % 2 + 1).alias("round_index"), F.when(F.col("toxic") == 0, "pass").otherwise("fail").alias("decision"))
    one = stats.run_stats(t("lineitem"), t("conversations"), t("events").select(F.col("event_type").alias("emotion_label")), t("documents").where("lang is not null").select(F.col("lang").alias("query_type")), traces, verdicts)
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return one.withColumns({c: shown(c) for c in ("emotions", "initial_types", "accepted_types", "rewrites")})


def _traces(t):
    e, i = t("events"), F.col("event_id")
    kinds = F.array(*map(F.lit, (*domains.QUERY_TYPES, "odd")))
    text_ = F.when(i % 62 == 0, F.lit("")).otherwise(F.concat("event_type", F.lit(" at the same place as "), (i % 30).cast("string")))
    rows = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("query_id"), F.element_at(kinds, (F.when(i % 40 == 0, 4).otherwise(i % 3 + 1)).cast("int")).alias("query_type"), F.when(i % 2 == 0, "accepted").when(i % 97 == 1, "lost").otherwise("discarded").alias("final_status"), text_.alias("final_query_text"))
    return rows.unionByName(rows.where("query_id % 200 = 0").withColumn("final_status", F.lit("discarded")))


@query(
    """WITH e AS (SELECT user_id AS v, event_id AS q, CASE WHEN event_id % 40 = 0 THEN 'odd' ELSE ['explicit_event', 'emotion_state', 'evidence_cue'][event_id % 3 + 1] END AS ty, CASE WHEN event_id % 2 = 0 THEN 'accepted' WHEN event_id % 97 = 1 THEN 'lost' ELSE 'discarded' END AS st, CASE WHEN event_id % 62 = 0 THEN '' ELSE event_type || ' at the same place as ' || event_id % 30 END AS x FROM events),
t AS (SELECT * FROM e UNION ALL SELECT v, q, ty, 'discarded', x FROM e WHERE q % 200 = 0),
a AS (SELECT * FROM t WHERE st = 'accepted'), c AS (SELECT v, x, list_distinct(string_split(x, ' ')) AS w, count(*) AS m FROM a WHERE x <> '' GROUP BY v, x), n AS (SELECT v, count(*) FILTER (WHERE st = 'accepted') AS n, count(DISTINCT CASE WHEN st = 'accepted' THEN ty END) AS k, min(CASE WHEN st = 'accepted' THEN ty END) AS ty FROM t GROUP BY v),
o AS (SELECT 'error' AS severity, 'status' AS kind, v, 1 AS n FROM t WHERE st = 'lost' UNION ALL SELECT 'error', 'type', v, 1 FROM t WHERE ty = 'odd' UNION ALL SELECT 'error', 'empty_text', v, 1 FROM a WHERE x = '' UNION ALL SELECT 'error', 'too_many', v, n FROM n WHERE n > 8
UNION ALL SELECT 'error', 'duplicate_text', v, count(*) - 1 FROM a GROUP BY v, x HAVING count(*) > 1 UNION ALL SELECT 'error', 'conflicting_status', v, 1 FROM a WHERE q % 200 = 0
UNION ALL SELECT 'warning', 'few', v, n FROM n WHERE n < 3 UNION ALL SELECT 'warning', 'one_type', v, n FROM n WHERE k = 1
UNION ALL SELECT 'warning', 'same_start', v, count(*) FROM a GROUP BY v, string_split(x, ' ')[1] HAVING count(*) > 3
UNION ALL SELECT 'warning', 'similar', v, count(*) * (count(*) - 1) // 2 FROM a WHERE x <> '' GROUP BY v, x HAVING count(*) > 1
UNION ALL SELECT 'warning', 'similar', p.v, p.m * r.m FROM c p JOIN c r ON p.v = r.v AND p.x < r.x WHERE len(list_intersect(p.w, r.w))::DOUBLE / greatest(len(p.w), len(r.w)) >= 0.7)
SELECT severity, kind, count(*) AS rows, count(DISTINCT v) AS videos, sum(n)::BIGINT AS n FROM o GROUP BY severity, kind"""
)
def violations_by_kind(t):
    v = quality.violations(_traces(t))
    return v.groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("video_id").alias("videos"), F.sum("n").alias("n"))


_SOUND = "(SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum([x::DOUBLE * x FOR x IN embedding]) > 0)"
_COS = f"(SELECT q.vec_id AS q, c.vec_id AS c, list_cosine_similarity(q.v, c.v) AS s FROM {_SOUND} q JOIN {_SOUND} c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"


def _nearest(t, k: int = 5):
    """The stated queries (ids divisible by 100) against all rows."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return similarity.nearest(e.where("id % 100 = 0"), e, k).withColumnsRenamed({"query": "q", "id": "c"})


@query(f"SELECT q, c, rk FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, c) AS rk FROM {_COS}) WHERE rk <= 5")
def topk_cosine(t):
    return _nearest(t).select("q", "c", "rk")


@query(f"SELECT count(DISTINCT q) FILTER (WHERE rk <= 1 AND s >= 0.9) AS r_at_1, count(DISTINCT q) FILTER (WHERE rk <= 5 AND s >= 0.9) AS r_at_5, count(DISTINCT q) AS n FROM (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, c) AS rk FROM {_COS})")
def recall_at_n(t):
    hit = lambda n: F.count_distinct(F.when((F.col("rk") <= n) & (F.col("s") >= 0.9), F.col("q")))
    return _nearest(t).agg(hit(1).alias("r_at_1"), hit(5).alias("r_at_5"), F.count_distinct("q").alias("n"))


_PREDS = f"(SELECT k, 'm' || line AS model, s, e FROM {_L})"


@query(f"WITH p AS {_PREDS}, i AS (SELECT a.k, max(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / (greatest(a.e, b.e) - least(a.s, b.s))) AS among FROM p a JOIN p b ON a.k = b.k AND a.model < b.model GROUP BY a.k), f AS (SELECT o.k, max(coalesce({_IOU}, 0)) AS best FROM {_O} o JOIN p ON o.k = p.k GROUP BY o.k) SELECT k, round(among, 6) AS among, round(best, 6) AS best FROM i JOIN f USING (k) WHERE among >= 0.5 AND best < 0.3")
def agreement_review(t):
    models = _lines(t).select("k", F.concat(F.lit("m"), "line").alias("model"), "start", "end")
    proposal = _orders(t).select("k", F.lit("proposal").alias("model"), F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    return evals.agreement_review(models.unionByName(proposal), "k")


@query("SELECT event_type, count(*) FILTER (WHERE n >= 3) AS fired, count(*) AS n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def multi_fire(t):
    g = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("event_type").agg(F.count_if(F.col("c") >= 3).alias("fired"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, (l_linenumber * 5)::VARCHAR || '-' || CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber * 5 + 7)::VARCHAR ELSE (l_linenumber * 5 + 7)::VARCHAR || '.5' END || 's' AS label FROM lineitem")
def time_labels(t):
    n = F.col("l_linenumber")
    r = F.array((n * 5).cast("double"), (n * 5 + 7).cast("double") + F.when(n % 2 == 1, 0.5).otherwise(0.0))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), text.time_label(r).alias("label"))


@query()
def bootstrap_ci(t):
    return evals.bootstrap(_scored(t), "iou", "k")


def _replies(prompt: str) -> str:
    """Deterministic answers by the kind of prompt."""
    n = sum(map(ord, prompt))
    if prompt.startswith("events"):
        label = domains.EMOTIONS[n % 8]
        return json.dumps([{"emotion_label": label, "event_description": "d", "time_range": [5.0 * i, 5.0 * i + 5], "target_person_or_group": "A", "visual_evidence": ["v"], "confidence": "high", "evidence_strength": "clear"} for i in range(1 + n % 3)])
    if prompt.startswith("queries"):
        return "Here: " + json.dumps([{"query_type": (*domains.QUERY_TYPES, "odd")[i], "query_text": f"When {i}?", "time_range": [3.0 * i, 3.0 * i + 4]} for i in range(1 + n % 4)])
    if prompt.startswith("verify"):
        return json.dumps({"pass": n % 7 != 0, "reason": "weak", "suggested_revision": f"Better {n % 10}" if n % 5 else ""})
    return json.dumps({"visual": f"scene {n % 100}", "audio": "a hum", "confidence": "medium", "evidence_strength": "clear"}) if n % 5 else "a plain sentence"


def fake_client() -> FakeClient:
    return FakeClient(_replies)


def _demo_segments(t):
    v = t("customer").select(F.format_string("v%07d", "c_custkey").alias("video_id"), (F.col("c_custkey") % 23 + 4).cast("double").alias("duration"))
    return spans.plan_segments(v, 5, 5).withColumn("clip_path", F.concat_ws("/", F.lit("clips"), "video_id", "segment_id"))


@query()
def captions_fake(t):
    return stages.caption_stage(_demo_segments(t), None, fake_client)


@query()
def events_fake(t):
    segments = _demo_segments(t)
    return stages.event_stage(stages.caption_stage(segments, None, fake_client), segments, fake_client, gap=2.5)


@query()
def verify_loop(t):
    segments = _demo_segments(t)
    captions = stages.settled(stages.caption_stage(segments, None, fake_client))
    events = stages.settled(stages.event_stage(captions, segments, fake_client, gap=2.5))
    return stages.verify_loop(stages.query_stage(captions, events, segments, fake_client), fake_client)
