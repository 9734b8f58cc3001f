"""The registered queries of this subpackage: each applies its operator to its
whole table and derives digest columns."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.session import ship

from . import common
from .embed_dedup import embedding_dedup
from .language_id import held_out, identify
from .license_scan import license_scan
from .main_text import extracted
from .media import media_columns
from .mixing import mix, position
from .packing import pack
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .variants import spelling_variants
from .vector_codes import vector_codes

TOKENIZERS = os.environ.get("SPANFORGE_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark, sf_dir):
    cut = suffix_dedup(_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_media_columns(spark, sf_dir):
    return media_columns(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    mixed = mix(_table(spark, sf_dir, "documents"))
    rows = mixed.select(common.doc_id_back().alias("doc_id"), "size", "source_size", "target", "taken", position().alias("position"))
    return rows.orderBy("position", "doc_id")


def op5_simhash_dedup(spark, sf_dir):
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(common.doc_id_back().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), common.doc_id_back("component").alias("component_id"))


def op6_best_fit_packing(spark, sf_dir):
    packed = pack(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs).select(common.doc_id_back().alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark, sf_dir):
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_main_text(spark, sf_dir):
    return extracted(_table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_counts, op3_media_columns, op4_mix_sources, op5_simhash_dedup, op6_best_fit_packing, op7_embedding_dedup, op8_substring_dedup, op9_language_id, op10_license_scan, op11_vector_codes, op12_main_text, op13_spelling_variants)}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST([0.5, 0.0, -0.5][place % 3 + 1] AS DOUBLE) AS ramp, 2.0::DOUBLE * source_size AS full_ FROM s),
l AS (SELECT *, full_ / weight AS level FROM w),
a AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_ FROM l),
t AS (
  SELECT source, source_size, ramp, CASE WHEN level > at_ THEN (max(CASE WHEN level > at_ THEN at_ END) OVER ()) * weight ELSE full_ END AS target FROM a),
d AS (
  SELECT z.doc_id, z.size, t.source_size, t.target, t.ramp, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.h, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(demand / source_size) AS BIGINT) END AS passes FROM d),
r AS (
  SELECT *, passes * size + greatest(0, least(demand - passes * source_size - before_, size)) AS taken FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CAST(floor((CASE WHEN ramp = 0 THEN before_ / target
    ELSE ((1 + ramp) - sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * (before_ / target))) / (2 * ramp) END) * 1000000) AS BIGINT) END AS position
FROM r
"""

_OP8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM starts),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE n > 1),
each AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

_ROUND = """
near{k} AS (
  SELECT id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist, any_value(x) AS x FROM (
    SELECT q.id, q.p, q.x, b.e, CAST(list_sum(list_transform(list_zip(q.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS dist FROM parts q JOIN book{k} b ON q.p = b.p)
  GROUP BY id, p)"""
_AVERAGE = """
mean{k} AS (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM near{k}) GROUP BY p, e, j) GROUP BY p, e),
book{next} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
_OP11 = f"""
WITH sound AS (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, embedding) AS id, vec_id, label, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (SELECT id, v, unnest(range(16)) AS p FROM sound)),
book0 AS (
  SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= 64),{_ROUND.format(k=0)},{_AVERAGE.format(k=0, next=1)},{_ROUND.format(k=1)},{_AVERAGE.format(k=1, next=2)},{_ROUND.format(k=2)},
coded AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near2 GROUP BY id),
labelled AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN sound USING (id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM sound JOIN coded USING (id) JOIN labelled ON sound.label IS NOT DISTINCT FROM labelled.label
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
sound AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN reach ON v.vec_id = reach.a LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
"""


# The pages of the tables have one article element each, of paragraphs and a title.
_OP12 = r"""
WITH cut AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '</?p>|</?h1>') AS parts FROM pages),
plain AS (
  SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN parts] AS parts FROM cut),
joined AS (
  SELECT page_id, url, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""

_OP13 = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT d, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY d, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: CAST(instr('0123456789ABCDEF', x[2 * k + 1]) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 17 AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, n, hex(d || ':' || w) AS x FROM runs) CROSS JOIN tab),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
cut AS (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN vocabulary y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN vocabulary y ON y.word = x.a || x.b),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM ways w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(here, step) AS root FROM ways GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": _OP4, "op7_embedding_dedup": _OP7, "op8_substring_dedup": _OP8, "op11_vector_codes": _OP11, "op12_main_text": _OP12, "op13_spelling_variants": _OP13}
