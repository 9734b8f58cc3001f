"""Checks of accepted queries, as one table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains
from ..functions.text import leading_phrase, words


def _sets(rows: DataFrame, key: str, ident: str, text: str) -> DataFrame:
    """(k, i, w): the set of words of each row that has any."""
    return rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.array_sort(F.array_distinct(words(F.col(text)))).alias("w")).where("size(w) > 0")


def all_similar_pairs(rows: DataFrame, key: str, ident: str, text: str, least: float = 0.7) -> DataFrame:
    """(key, a, b, overlap), a < b: every pair of rows of one key whose words overlap enough,
    equal texts too. Classes are compared, then their rows are paired."""
    sets = _sets(rows, key, ident, text)
    rep = sets.groupBy("k", "w").agg(F.min("i").alias("c"))
    members = sets.join(rep, ["k", "w"]).select(F.col("k").alias(key), "c", "i")
    x, y = (members.select(key, F.col("c").alias(c), F.col("i").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    each = similar_pairs(rows, key, ident, text, least).join(x, [key, "a"]).join(y, [key, "b"]).where("if(a = b, x < y, x <> y)")
    return each.select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def similar_pairs(rows: DataFrame, key: str, ident: str, text: str, least: float = 0.7) -> DataFrame:
    """(key, a, b, pairs, overlap): classes of rows of one key whose words overlap enough.

    Rows of one set of words are a class, named by its smallest ``ident``, so equal texts
    come out as one row (a = b, overlap 1) however many there are; ``pairs`` is how many
    pairs of rows a row stands for. Texts without words are alike to nothing.

    Two sets with ``least`` of the larger in common share a word among the first
    ``n - ceil(least n) + 1`` of each, in any one order of words: classes meet there only,
    rarest words of the key first, so a common word brings none together."""
    sets = _sets(rows, key, ident, text)
    classes = sets.groupBy("k", "w").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("m"))
    each = classes.select("k", "i", F.size("w").alias("n"), F.explode("w").alias("word"))
    counts = each.groupBy("k", "word").agg(F.count(F.lit(1)).alias("c"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    ordered = each.join(counts, ["k", "word"]).groupBy("k", "i", "n").agg(F.sort_array(F.collect_list(F.struct("c", "word"))).alias("s"))
    heads = ordered.select("k", "i", F.explode(F.slice("s", F.lit(1), first.cast("int"))).alias("x")).select("k", "i", "x.word")
    met = heads.join(heads.withColumnRenamed("i", "j"), ["k", "word"]).where("i < j").select("k", "i", "j").distinct()
    a, b = (classes.select("k", F.col("i").alias(c), F.col("w").alias(f"w{c}"), F.col("m").alias(f"m{c}")) for c in ("i", "j"))
    both = met.join(a, ["k", "i"]).join(b, ["k", "j"])
    both = both.withColumn("overlap", F.size(F.array_intersect("wi", "wj")) / F.greatest(F.size("wi"), F.size("wj"))).where(F.col("overlap") >= least)
    apart = both.select(F.col("k").alias(key), F.col("i").alias("a"), F.col("j").alias("b"), (F.col("mi") * F.col("mj")).alias("pairs"), "overlap")
    own = classes.where("m > 1").select(F.col("k").alias(key), F.col("i").alias("a"), F.col("i").alias("b"), F.expr("m * (m - 1) div 2").alias("pairs"), F.lit(1.0).alias("overlap"))
    return apart.unionByName(own)


def violations(traces: DataFrame, most: int = 8, fewest: int = 3, most_alike: int = 3) -> DataFrame:
    """(video_id, severity, kind, subject, n) over (video_id, query_id, query_type,
    final_status, final_query_text). Errors sort before warnings. All kinds come from one
    scan and one grouping by what each row is counted under, but for ``similar``, which
    has a row for each pair of classes of texts, n being the pairs of queries."""
    status, kind_of, said = F.col("final_status"), F.col("query_type"), F.col("final_query_text")
    accepted = F.coalesce(status == "accepted", F.lit(False))
    known = lambda c, domain: F.coalesce(c.isin(*domain), F.lit(False))
    under = lambda kind, subject, when: F.when(when, F.struct(F.lit(kind).alias("kind"), subject.cast("string").alias("subject")))
    ident = F.col("query_id")
    places = [
        under("status", ident, ~known(status, domains.STATUSES)),
        under("type", ident, ~known(kind_of, domains.QUERY_TYPES)),
        under("empty_text", ident, accepted & (F.length(F.trim(F.coalesce(said, F.lit("")))) == 0)),
        under("duplicate_text", said, accepted),
        under("conflicting_status", ident, known(status, domains.STATUSES)),
        under("same_start", leading_phrase(said), accepted),
        under("video", F.lit(None), F.lit(True)),
    ]
    each = traces.select("video_id", accepted.alias("a"), F.coalesce(status == "discarded", F.lit(False)).alias("d"), F.when(accepted, kind_of).alias("t"), F.explode(F.array_compact(F.array(*places))).alias("p"))
    g = each.groupBy("video_id", "p.kind", "p.subject").agg(F.count(F.lit(1)).alias("rows"), F.count_if("a").alias("n"), F.count_if("d").alias("gone"), F.min("t").alias("low"), F.max("t").alias("high"))

    def found(severity: str, kind: str, when, subject, n, times=None):
        row = F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))
        return F.when(when, F.array_repeat(row, times.cast("int") if times is not None else F.lit(1)))

    is_, n, one, nothing, subject = (lambda k: F.col("kind") == k), F.col("n"), F.lit(1), F.lit(None), F.col("subject")
    per_row = [found("error", k, is_(k), subject, one, F.col("rows")) for k in ("status", "type", "empty_text")]
    told = [
        *per_row,
        found("error", "too_many", is_("video") & (n > most), nothing, n),
        found("error", "duplicate_text", is_("duplicate_text") & (n > 1), F.left(subject, F.lit(80)), n - 1),
        found("error", "conflicting_status", is_("conflicting_status") & (n > 0) & (F.col("gone") > 0), subject, one),
        found("warning", "few", is_("video") & (n < fewest), nothing, n),
        found("warning", "one_type", is_("video") & (F.col("low") == F.col("high")), F.col("low"), n),
        found("warning", "same_start", is_("same_start") & (n > most_alike), subject, n),
    ]
    rows = g.select("video_id", F.inline(F.flatten(F.array_compact(F.array(*told)))))
    alike = similar_pairs(traces.where(accepted), "video_id", "query_id", "final_query_text")
    return rows.unionByName(alike.select("video_id", F.lit("warning").alias("severity"), F.lit("similar").alias("kind"), F.concat_ws("|", "a", "b").alias("subject"), F.col("pairs").cast("long").alias("n")))
