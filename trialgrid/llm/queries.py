"""The training-data queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_hits
from .filter_audit import audit_filters
from .fingerprint import compare_with_edits
from .html_extract import extract_pages
from .jaccard_join import jaccard_join
from .language_id import identify_languages
from .mixing import mix_sources
from .pitman_yor import score_documents
from .secret_scan import scan_secrets
from .sentencepiece_codec import encode_documents, read_model
from .spelling import group_spellings
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    coded = encode_documents(_table(spark, sf_dir, "documents"), read_model(public_tokenizers.path(model)))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_pitman_yor, op3_suffix_dedup, op4_language_id, op5_toxicity,
        op6_decontamination, op7_mixing, op8_html_extract, op9_jaccard_join, op10_fingerprint,
        op11_spelling, op12_filter_audit, op13_sentencepiece,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
spots AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS n FROM spots),
sizes AS (SELECT DISTINCT n FROM wins),
spans AS (SELECT d.doc_id, d.w, sizes.n, unnest(range(1, len(d.w) - sizes.n + 2)) AS k FROM d, sizes WHERE len(d.w) >= sizes.n),
hits AS (SELECT spans.doc_id, spans.k, spans.n, wins.item FROM spans JOIN wins ON wins.n = spans.n AND wins.win = array_to_string(spans.w[spans.k:spans.k + spans.n - 1], ' ')),
words AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS word FROM hits),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(n_hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH based AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS base
  FROM documents),
sized AS (
  SELECT doc_id, source, size,
    CAST('0x' || substr(md5(concat(base, '|', CAST(row_number() OVER (PARTITION BY source, base) AS VARCHAR))), 1, 15) AS BIGINT) AS k
  FROM based),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT z.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
    sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k) AS upto,
    sum(z.size) OVER (PARTITION BY z.source, z.k) AS own
  FROM sized z JOIN e ON z.source IS NOT DISTINCT FROM e.source),
f AS (SELECT *, min(CASE WHEN upto > rest THEN upto END) OVER (PARTITION BY source) AS edge FROM c)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto = edge AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM f
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
  FROM d WHERE len(w) > 0),
keyed AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS h, s FROM sh),
sets AS (SELECT h, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n, arg_min(s, doc_id) AS s FROM keyed GROUP BY h),
flat AS (SELECT h, n, unnest(s) AS x FROM sets),
meets AS (SELECT a.h AS a, b.h AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM flat a JOIN flat b ON a.x = b.x AND a.h <> b.h GROUP BY a.h, b.h),
links AS (SELECT a, b FROM meets WHERE m >= 0.8 * (na + nb - m) - 1e-6 * (na + nb - m)),
degree AS (SELECT a AS h, count(*) AS texts, sum(copies) AS others FROM links JOIN sets ON sets.h = links.b GROUP BY a),
reach(h, o) AS (SELECT h, h FROM sets UNION SELECT reach.h, links.b FROM reach JOIN links ON links.a = reach.o),
classes AS (SELECT reach.h, min(sets.rep) AS class_id FROM reach JOIN sets ON sets.h = reach.o GROUP BY reach.h)
SELECT d.doc_id, coalesce(classes.class_id, d.doc_id) AS class_id, coalesce(sets.rep, d.doc_id) AS copy_of,
  CAST(coalesce(keyed.n, 0) AS INTEGER) AS n_shingles, CAST(coalesce(degree.texts, 0) AS BIGINT) AS n_texts,
  CAST(coalesce(degree.others, 0) + coalesce(sets.copies - 1, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN keyed USING (doc_id) LEFT JOIN sets ON sets.h = keyed.h LEFT JOIN degree ON degree.h = keyed.h LEFT JOIN classes ON classes.h = keyed.h
"""


OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substring(h, i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS s FROM (SELECT *, hex(encode(id || ':' || run)) AS h FROM lowered), steps),
cut AS (SELECT CASE WHEN s % 31 = 0 THEN substring(run, 1, CAST(s % length(run) AS INTEGER)) || substring(run, CAST(s % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM summed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
without AS (SELECT word, n, k, substring(word, 1, k) || substring(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM without a JOIN without b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, v.word, v.n FROM without a JOIN v ON v.word = a.rest UNION SELECT v.word, v.n, a.word, a.n FROM without a JOIN v ON v.word = a.rest),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 10 * n),
chain(word, stop, depth) AS (SELECT word, form, 1 FROM forms UNION ALL SELECT chain.word, forms.form, depth + 1 FROM chain JOIN forms ON forms.word = chain.stop),
ends AS (SELECT word, arg_max(stop, depth) AS root FROM chain GROUP BY word)
SELECT v.word, forms.form, coalesce(ends.root, v.word) AS root, v.n, coalesce(best.n_near, 0) AS n_near, forms.form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS fails FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
a(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS o FROM a p, a q, a r, a s, a u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT o, CAST(k AS INTEGER) AS step, o[k] AS own, o[:k - 1] AS before FROM orders, range(1, 6) s(k)),
run AS (SELECT g.*, o, step, own, fails[own] AS hit, len(list_filter(string_split(before, ''), lambda x: x <> '' AND fails[x])) > 0 AS gone,
  len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS alone FROM g, steps),
sums AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
  coalesce(sum(n) FILTER (hit AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM run GROUP BY ALL)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op7_mixing": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op11_spelling": OP11_SQL, "op12_filter_audit": OP12_SQL}
