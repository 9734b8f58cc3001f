"""Grounding, verification and judge scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains
from ..functions.spans import iou
from ..functions.text import says_yes
from .stats import ratio

THRESHOLDS = (0.3, 0.5, 0.7)


def grounded(gold: DataFrame, pred: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Gold rows with their prediction (``p_start``, ``p_end``), null if missing or
    not positive: a miss stays in the denominator."""
    p = pred.select(key, F.col(start).alias("__s"), F.col(end).alias("__e"))
    ok = F.col("__e") > F.col("__s")
    return gold.join(p, key, "left").withColumns({"p_start": F.when(ok, F.col("__s")), "p_end": F.when(ok, F.col("__e"))}).drop("__s", "__e")


def score_columns(value: Column, missing: Column) -> list[Column]:
    """Aggregates of an IoU column."""
    hits = [F.avg((value >= t).cast("double")).alias(f"r_at_{int(t * 10)}") for t in THRESHOLDS]
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("miou"), F.avg(missing.cast("double")).alias("parse_fail"), *hits]


def scores(rows: DataFrame, kind: str, value: str = "iou", missing: str = "missing") -> DataFrame:
    """By kind and overall (null kind) in one pass."""
    return rows.rollup(kind).agg(*score_columns(F.col(value), F.col(missing)))


def grounding_score(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (iou, grid_j, missing) -> n, mean IoU, parse failures, mean grid Jaccard and
    recall at each threshold, by kind or over all; a miss counts as 0."""
    iou_, grid = F.coalesce("iou", F.lit(0.0)), F.coalesce("grid_j", F.lit(0.0))
    return rows.groupBy(*by).agg(*score_columns(iou_, F.col("missing")), F.round(F.avg(grid), 6).alias("grid_jaccard")).orderBy(*by)


def accuracy(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of equal gold and predicted values of each dimension, over rows that have
    both, and the mean of the dimensions."""
    one = rows.agg(*[F.avg((F.col(g) == F.col(p)).cast("double")).alias(n) for n, (g, p) in pairs.items()])
    return one.select(*[F.round(n, 6).alias(n) for n in pairs], F.round(sum(F.col(n) for n in pairs) / len(pairs), 6).alias("mean"))


# Words by which a query speaks of something heard.
AUDIO_CUES = ("tone", "voice", "says", "laugh", "cry", "gasp", "scream", "sound", "sing", "whisper")


#: What may stand behind a cue within its word.
CUE_ENDS = "(?:s|d|ed|ing)?"


def audio_cue(query_text: Column, words: tuple[str, ...] = AUDIO_CUES) -> Column:
    """Whether a query speaks of something heard: one of the words, or one with an ending."""
    return F.coalesce(query_text.rlike(f"(?i)(?:^|[^a-z])(?:{'|'.join(words)}){CUE_ENDS}(?:$|[^a-z])"), F.lit(False))


def too_narrow(start: Column, end: Column, gold_start: Column, gold_end: Column) -> Column:
    """Whether a proposal lies inside the human span and is shorter."""
    return (start >= gold_start) & (end <= gold_end) & (end - start < gold_end - gold_start)


def span_sizes(rows: DataFrame, ids: str = "segment_ids") -> DataFrame:
    """(n_segments, n): how many segments the spans have."""
    return rows.groupBy(F.size(ids).alias("n_segments")).agg(F.count(F.lit(1)).alias("n"))


def capped_and_not(traces: DataFrame, by: str, capped: Column) -> DataFrame:
    """(by, n, pass_rate, acceptance): passed before the cap of a video, and after it."""
    passed = F.col("final_status") == "accepted"
    n = F.count(F.lit(1))
    return traces.groupBy(by).agg(n.alias("n"), F.round(ratio(F.count_if(passed | capped), n), 6).alias("pass_rate"), F.round(ratio(F.count_if(passed & ~capped), n), 6).alias("acceptance"))


def groundable(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations that can be grounded, and the counts of kept and dropped ones."""
    drop = F.coalesce(F.col("not_groundable"), F.lit(False))
    return annotations.where(~drop), annotations.agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"))


def similar_span(pairs: DataFrame, key: str, least: float, gap: float = 0.0) -> DataFrame:
    """(key, start, end): of captions (key, start, end, s) whose similarity reaches
    ``least``, spans at most ``gap`` apart are merged; the one of greatest total wins."""
    from .intervals import islands

    near = islands(pairs.where(F.col("s") >= least), key, "start", "end", ["start", "end"], [], F.lit(gap))
    spans_ = near.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("s").alias("s"))
    return spans_.groupBy(key).agg(F.max_by(F.struct("start", "end"), F.struct("s", F.negative("start").alias("n"))).alias("x")).select(key, "x.*")


_ROWS = 512  # rows that are drawn for at once


def _share(bounds: np.ndarray, part: int, total: np.ndarray, seed: int) -> np.ndarray:
    """How many of a resample's draws fall into part ``part`` of the rows, by halving the
    parts: each halving is a binomial draw seeded by its place alone, so every task that
    passes it sees the same. ``bounds``: rows before each part, and all."""
    lo, hi = 0, len(bounds) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        here, left = bounds[hi] - bounds[lo], bounds[mid] - bounds[lo]
        chosen = np.random.default_rng([seed, lo, hi]).binomial(total, left / here if here else 0.0)
        total, lo, hi = (chosen, lo, mid) if part < mid else (total - chosen, mid, hi)
    return total


def _weights(size: int, total: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(rows, resamples): multinomial counts of ``total`` draws from ``size`` equal rows."""
    draws = np.repeat(np.arange(len(total)), total)
    cells = rng.integers(0, size, len(draws)) * len(total) + draws
    return np.bincount(cells, minlength=size * len(total)).reshape(size, len(total))


def _resampled(draws: int, bounds: np.ndarray, seed: int):
    """Sums of weights and weighted values of each resample, one row a task and resample."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        left = int(bounds[part + 1] - bounds[part])
        total = _share(bounds, part, np.full(draws, bounds[-1]), seed)
        rng = np.random.default_rng([seed, 1 << 40, part])
        weights, values = np.zeros(draws, np.int64), np.zeros(draws)
        for batch in batches:
            v = batch.column("v").to_numpy(zero_copy_only=False)
            for i in range(0, len(v), _ROWS):
                some = v[i : i + _ROWS]
                own = total if len(some) == left else rng.binomial(total, len(some) / left)
                w = _weights(len(some), own, rng)
                weights += w.sum(axis=0)
                values += some @ w
                total, left = total - own, left - len(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(weights), pa.array(values)], names=["rep", "w", "x"])

    return run


def resamples(rows: DataFrame, value: str, key: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(rep, w, x): for each of ``draws`` resamples the number of rows drawn, which is the
    number of rows there are, and the sum of their values. The draws are shared out over
    the partitions by halving, and within one over its rows, in the order of ``key``'s
    hash; no row moves or multiplies. Rows of a null value are not drawn from."""
    from .stages import settled

    own = rows.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))
    own = settled(own.sortWithinPartitions("h", "v").select("v"))  # one fixed layout for both passes
    sizes = dict(own.groupBy(F.spark_partition_id().alias("p")).count().toLocalIterator())
    if not sizes:
        return rows.sparkSession.createDataFrame([], "rep long, w long, x double")
    parts = max(sizes) + 1
    bounds = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])]).astype(np.int64)
    inside = own.where(F.spark_partition_id() < parts)
    sums = inside.mapInArrow(_guarded(_resampled(draws, bounds, seed), parts), "rep long, w long, x double")
    return sums.groupBy("rep").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))


def _guarded(run, parts: int):
    """``run`` for the partitions that hold rows; others follow the last of them."""

    def some(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() < parts:
            yield from run(batches)

    return some


def bootstrap(rows: DataFrame, value: str, key: str, draws: int = 1000, low: int = 25, high: int = 975, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean over ``draws`` resamples of all rows, each of exactly
    as many draws with replacement as there are rows. Null without rows."""
    means = resamples(rows, value, key, draws, seed).groupBy("rep").agg(F.try_divide(F.sum("x"), F.sum("w")).alias("m"))
    s = F.sort_array(F.collect_list("m"))
    return means.agg(F.try_element_at(s, F.lit(low + 1)).alias("lo"), F.try_element_at(s, F.lit(high + 1)).alias("hi"))


def prf(gold: Column, pred: Column) -> list[Column]:
    """Precision, recall and F1 of True, with their counts."""
    tp, fp, fn = F.count_if(gold & pred), F.count_if(~gold & pred), F.count_if(gold & ~pred)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def decision_metrics(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy, F1 of acceptance and the share of other gold rows passed by mistake,
    over rows that have a gold decision."""
    g, p = F.col(gold), F.col(pred)
    tp, fp, fn = F.count_if((g == "pass") & (p == "pass")), F.count_if((g != "pass") & (p == "pass")), F.count_if((g == "pass") & (p != "pass"))
    return rows.where(g.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(ratio(F.count_if(g == p), F.count(F.lit(1))), 6).alias("accuracy"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("accept_f1"),
        F.round(ratio(fp, F.count_if(g != "pass")), 6).alias("false_pass"),
    )


# Fixed value: the reason of a query that got no verdict.
NO_VERDICT = "verification output missing or invalid format"


def format_failures(results: DataFrame, reason: str = NO_VERDICT) -> DataFrame:
    """Share of rows whose reason is exactly that of a verdict that is missing, and of
    those that contain it or a failed call."""
    r = F.coalesce(F.col("failure_reason"), F.lit(""))
    return results.agg(ratio(F.count_if(r == reason), F.count(F.lit(1))).alias("json_err"), ratio(F.count_if(r.contains(reason) | r.contains("call failed")), F.count(F.lit(1))).alias("any_err"))


def judge_means(rows: DataFrame, dims: list[str], group: str) -> DataFrame:
    """(group, dim, mean, n) over scores that are not null."""
    long = rows.unpivot(group, dims, "dim", "score")
    return long.groupBy(group, "dim").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def combined_score(means: DataFrame, group: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the dimensions that have one."""
    weights = weights or domains.CAPTION_WEIGHTS
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("dim")]
    w = F.when(F.col("mean").isNotNull(), w)
    return means.groupBy(group).agg(F.round(F.try_divide(F.sum(w * F.col("mean")), F.sum(w)), 6).alias("combined"))


def compared(rows: DataFrame, margin: float = 0.02) -> DataFrame:
    """Two IoU columns ``a`` and ``b``: means, hits, and rows better or worse by more
    than the margin."""
    a, b = F.col("a"), F.col("b")
    return rows.agg(F.round(F.avg(a), 6).alias("miou_a"), F.round(F.avg(b), 6).alias("miou_b"), F.count_if(a >= 0.5).alias("hit_a"), F.count_if(b >= 0.5).alias("hit_b"), F.count_if(b > a + margin).alias("better"), F.count_if(b < a - margin).alias("worse"))


def agreement_review(preds: DataFrame, key: str, agree: float = 0.5, far: float = 0.3) -> DataFrame:
    """(key, model, start, end) and a proposal (model 'proposal'): keys where two models
    agree with each other yet all are far from the proposal."""
    models, proposal = preds.where("model <> 'proposal'"), preds.where("model = 'proposal'").select(key, F.col("start").alias("ps"), F.col("end").alias("pe"))
    a = models.select(key, F.col("model").alias("ma"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = models.select(key, F.col("model").alias("mb"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    agreed = a.join(b, key).where("ma < mb").groupBy(key).agg(F.max(iou(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))).alias("among"))
    best = models.join(proposal, key).groupBy(key).agg(F.max(iou(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"))).alias("best"))
    return agreed.join(best, key).where((F.col("among") >= agree) & (F.col("best") < far)).select(key, F.round("among", 6).alias("among"), F.round("best", 6).alias("best"))


def length_bucket(duration: Column, short: float = 60, long: float = 150) -> Column:
    return F.when(duration <= short, "short").when(duration > long, "long").otherwise("mid")


def widened(start: Column, end: Column, duration: Column, by: float = 2.5) -> tuple[Column, Column]:
    """A span made wider to both sides, within the video."""
    return F.when(start.isNotNull(), F.greatest(start - by, F.lit(0))), F.when(end.isNotNull(), F.least(end + by, duration))


def front_prior(duration: Column, share: float = 0.3) -> tuple[Column, Column]:
    """The baseline that always answers the front of the video."""
    return F.lit(0).cast("double"), duration * share


def cue_check(replies: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, flagged): a cue is flagged unless the reply for any clip is yes."""
    return replies.groupBy(key, label).agg((~F.bool_or(says_yes(F.col("reply")))).alias("flagged"))


def cue_confusion(checked: DataFrame, label: str, bad: str = "HALLUC", good: str = "GOOD") -> DataFrame:
    """One row: tp, fn (bad cues flagged or not), fp, tn (good ones)."""
    b, g, f = F.col(label) == bad, F.col(label) == good, F.col("flagged")
    return checked.agg(*[F.count_if(c).alias(n) for n, c in (("tp", b & f), ("fn", b & ~f), ("fp", g & f), ("tn", g & ~f))])


# The columns of a table of verification metrics, in its order.
METRICS = ("label", "n", "dec_acc", "dim_acc_avg", "rel_acc", "ans_acc", "qual_acc", "accept_f1", "false_pass", "json_err", "rel_prec", "rel_recall", "rel_f1", "ans_prec", "ans_recall", "ans_f1", "qual_prec", "qual_recall", "qual_f1")
_DIMENSIONS = {"rel": ("gold_emotion_relevant", "emotion_relevance_pass"), "ans": ("gold_answerability", "answerability_pass"), "qual": ("gold_query_quality", "query_quality_pass")}


def verification_metrics(results: DataFrame, gold: DataFrame, reason: str = NO_VERDICT) -> DataFrame:
    """A row of METRICS for each label of ``results`` (label, query_id, decision, the three
    passes, failure_reason) against ``gold`` (query_id, gold_decision and the three golds),
    sorted by label. Of several results of one query and label any one counts; a gold row
    without a decision does not count; a null pass is no pass. Rates of nothing are 0."""
    n = F.count(F.lit(1))
    passes = [p for _, p in _DIMENSIONS.values()]
    one = results.groupBy("label", "query_id").agg(F.max(F.struct("decision", *passes)).alias("r")).select("label", "query_id", "r.*")
    golds = [g for g, _ in _DIMENSIONS.values()]
    pairs = one.join(gold.where("gold_decision IS NOT NULL").select("query_id", "gold_decision", *golds), "query_id")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    g, d = F.col("gold_decision") == "pass", F.coalesce(F.col("decision") == "pass", F.lit(False))
    tp, fp, fn = F.count_if(g & d), F.count_if(~g & d), F.count_if(g & ~d)
    columns = [n.alias("n"), ratio(F.count_if(F.col("gold_decision") == F.col("decision")), n).alias("dec_acc"), ratio(2 * tp, 2 * tp + fp + fn).alias("accept_f1"), ratio(fp, F.count_if(~g)).alias("false_pass")]
    for name, (of, said) in _DIMENSIONS.items():
        a, b = is_(of), is_(said)
        t, p, m = F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b)
        columns += [ratio(F.count_if(a == b), n).alias(f"{name}_acc"), ratio(t, t + p).alias(f"{name}_prec"), ratio(t, t + m).alias(f"{name}_recall"), ratio(2 * t, 2 * t + p + m).alias(f"{name}_f1")]
    failed = results.groupBy("label").agg(ratio(F.count_if(F.coalesce("failure_reason", F.lit("")) == reason), n).alias("json_err"))
    rows = failed.join(pairs.groupBy("label").agg(*columns), "label", "left")
    rows = rows.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c not in ("label",) and c in rows.columns else F.col(c) for c in rows.columns])
    average = ((F.col("rel_acc") + F.col("ans_acc") + F.col("qual_acc")) / 3).alias("dim_acc_avg")
    return rows.withColumn("dim_acc_avg", average).select(*METRICS).orderBy("label")
