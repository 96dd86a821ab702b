"""Text queries over documents.

The documents have no placeholders or section headers, so queries and oracles both derive a marked
text: addresses become bracketed placeholders, dotted quads underscores, and a header block is put
in front, chosen by the id.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.plans.base import query, table

#: A note with so many sections counts as sectioned.
SECTIONED = 4

_MARK_SQL = r"""marked AS (SELECT doc_id, lang, source, CASE doc_id % 6
  WHEN 0 THEN E'History of Present Illness:\nwell PHI\n' WHEN 1 THEN E'Assessment :\nx ______ y\nassessment:\n' WHEN 2 THEN E'Planned visit\n  PLAN: [**a**] 12\n'
  WHEN 3 THEN E'\n\nHospital Course by 3 systems\nhospital course:\n' WHEN 4 THEN E'cc: [**b c**]\nPMH\n' ELSE E'HPI\nPMH:\nassessment\nPlan:\nchief complaint\n' END ||
  regexp_replace(regexp_replace(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '[**Email**]', 'g'), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', '____', 'g') AS text FROM documents)"""
_HEADERS_SQL = "(?:" + "|".join(tx.SECTION_HEADERS) + ")"
_TOKENS_SQL = r"list_filter(regexp_split_to_array(s, '[\s\x0b\x1c-\x1f\x85\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+'), lambda x: x <> '')"
_FEATURES_SQL = rf"""surf AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(text, '\[\*\*.*?\*\*\]', 'PHI', 'g'), '___+', 'PHI', 'g') AS s FROM marked),
tok AS (SELECT *, {_TOKENS_SQL} AS t FROM surf),
feat AS (SELECT doc_id, lang, source, s, length(s) AS length, len(t) AS n_tokens,
  len(list_distinct(list_transform(regexp_extract_all(s, '(?mi)^\s*{_HEADERS_SQL}\s*:?'), lambda m: regexp_replace(lower(trim(m, E' \n\t\r')), ':+$', '')))) AS n_sections,
  len(list_filter(t, lambda x: regexp_matches(x, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]'))) / greatest(len(t), 1) AS numeric_density,
  len(regexp_extract_all(s, '\bPHI\b')) / greatest(len(t), 1) AS phi_density FROM tok)"""


def _marked(spark, d):
    k = F.col("doc_id") % 6
    head = (
        F.when(k == 0, "History of Present Illness:\nwell PHI\n").when(k == 1, "Assessment :\nx ______ y\nassessment:\n").when(k == 2, "Planned visit\n  PLAN: [**a**] 12\n")
        .when(k == 3, "\n\nHospital Course by 3 systems\nhospital course:\n").when(k == 4, "cc: [**b c**]\nPMH\n").otherwise("HPI\nPMH:\nassessment\nPlan:\nchief complaint\n")
    )
    body = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "[**Email**]"), r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "____")
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(head, body).alias("text"))


def _features(spark, d):
    return _marked(spark, d).select("doc_id", "lang", "source", *tx.surface_features(F.col("text")))


@query(f"WITH {_MARK_SQL}, {_FEATURES_SQL} SELECT doc_id, length, n_tokens, n_sections, round(numeric_density, 6) AS numeric_density, round(phi_density, 6) AS phi_density FROM feat")
def doc_features(spark, d):
    return _features(spark, d).select("doc_id", "length", "n_tokens", "n_sections", F.round("numeric_density", 6).alias("numeric_density"), F.round("phi_density", 6).alias("phi_density"))


_PERIOD_SQL = f"WITH {_MARK_SQL}, {_FEATURES_SQL}, p AS (SELECT lang AS period, count(*) AS n_notes, avg(length) AS mean_length, stddev_pop(length) AS std_length, avg((n_sections >= 4)::INT) AS section_rate, avg(n_sections) AS mean_sections, avg(numeric_density) AS numeric_density, avg(phi_density) AS phi_density FROM feat GROUP BY 1)"


def _periods(spark, d):
    return _features(spark, d).groupBy(F.col("lang").alias("period")).agg(
        F.count("*").alias("n_notes"), F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"), F.avg((F.col("n_sections") >= SECTIONED).cast("int")).alias("section_rate"),
        F.avg("n_sections").alias("mean_sections"), F.avg("numeric_density").alias("numeric_density"), F.avg("phi_density").alias("phi_density"),
    )


@query(_PERIOD_SQL + " SELECT period, n_notes, round(mean_length, 6) AS mean_length, round(std_length, 6) AS std_length, round(section_rate, 6) AS section_rate, round(mean_sections, 6) AS mean_sections, round(numeric_density, 6) AS numeric_density, round(phi_density, 6) AS phi_density FROM p")
def surface_by_period(spark, d):
    p = _periods(spark, d)
    return p.select("period", "n_notes", *[F.round(c, 6).alias(c) for c in p.columns[2:]])


@query(_PERIOD_SQL + " SELECT period, round(coalesce((mean_length - avg(mean_length) OVER ()) / nullif(stddev_pop(mean_length) OVER (), 0), 0), 6) AS z_length, round(coalesce((mean_sections - avg(mean_sections) OVER ()) / nullif(stddev_pop(mean_sections) OVER (), 0), 0), 6) AS z_sections FROM p")
def period_zscores(spark, d):
    w = Window.partitionBy(F.lit(1))  # over the few periods

    def z(c):
        return F.round(F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0)), 6)

    return _periods(spark, d).select("period", z("mean_length").alias("z_length"), z("mean_sections").alias("z_sections"))


@query(_PERIOD_SQL + " SELECT p.period, round(100 * (p.mean_length - b.mean_length) / b.mean_length, 6) AS length_change_pct, round(100 * (p.section_rate - b.section_rate), 6) AS section_gap_pp FROM p, (SELECT * FROM p WHERE period = 'en') b WHERE p.period <> 'en'")
def window_contrasts(spark, d):
    p = _periods(spark, d).select("period", "mean_length", "section_rate")
    b = p.where("period = 'en'").select(F.col("mean_length").alias("bl"), F.col("section_rate").alias("bs"))
    return p.where("period <> 'en'").crossJoin(F.broadcast(b)).select("period", F.round(100 * (F.col("mean_length") - F.col("bl")) / F.col("bl"), 6).alias("length_change_pct"), F.round(100 * (F.col("section_rate") - F.col("bs")), 6).alias("section_gap_pp"))


_VOCAB_SQL = "w AS (SELECT lang AS period, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), c AS (SELECT period, word, count(*) AS n FROM w GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, word) AS rank FROM c)"


def _vocabulary(spark, d, n):
    counts = table(spark, d, "documents").select(F.col("lang").alias("period"), F.explode(tx.words(F.col("text"))).alias("word")).groupBy("period", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.col("n").desc(), "word"))).where(F.col("rank") <= n)


@query(f"WITH {_VOCAB_SQL} SELECT period, word, n, rank FROM v WHERE rank <= 500")
def vocab_top500(spark, d):
    return _vocabulary(spark, d, 500)


@query(f"WITH {_VOCAB_SQL}, t AS (SELECT * FROM v WHERE rank <= 500), s AS (SELECT period, count(*) AS n FROM t GROUP BY 1), i AS (SELECT a.period, count(*) AS shared FROM t a JOIN t b ON a.word = b.word AND b.period = 'en' GROUP BY 1) SELECT s.period, round(coalesce(shared, 0) / (s.n + (SELECT n FROM s WHERE period = 'en') - coalesce(shared, 0)), 6) AS jaccard FROM s LEFT JOIN i USING (period)")
def vocab_jaccard(spark, d):
    sets = _vocabulary(spark, d, 500).groupBy("period").agg(F.collect_list("word").alias("v"))  # 500 words each
    return sets.crossJoin(F.broadcast(sets.where("period = 'en'").select(F.col("v").alias("b")))).select("period", F.round(tx.jaccard(F.col("v"), F.col("b")), 6).alias("jaccard"))


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents) SELECT word, count(*) AS df FROM w GROUP BY 1 ORDER BY df DESC, word LIMIT 500")
def doc_freq_vocab(spark, d):
    docs = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "word").limit(500)


@query(rf"WITH {_MARK_SQL}, k AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?mi)^\s*{_HEADERS_SQL}\s*:?'), lambda m: regexp_replace(regexp_replace(lower(trim(m, E' \n\t\r')), ':+$', ''), '\s+', ' ', 'g')))) AS header FROM marked) SELECT header, count(*) AS n_docs FROM k GROUP BY 1")
def section_counts(spark, d):
    return _marked(spark, d).select(F.explode(tx.section_keys(F.col("text"), collapse=True)).alias("header")).groupBy("header").agg(F.count("*").alias("n_docs"))


@query(rf"WITH {_MARK_SQL} SELECT doc_id, regexp_matches(text, '(?mi)^\s*(?:brief\s+hospital\s+course|hospital\s+course|summary\s+of\s+hospital\s+course)') AS has_course FROM marked")
def header_presence(spark, d):
    return _marked(spark, d).select("doc_id", tx.has_course(F.col("text")).alias("has_course"))


@query(rf"WITH {_MARK_SQL} SELECT doc_id, sha256(replace(regexp_replace(text, '\[\*\*.*?\*\*\]', 'unknown', 'g'), '___', 'unknown')) AS encoder_sha, sha256(regexp_replace(regexp_replace(text, '\[\*\*.*?\*\*\]', 'PHI', 'g'), '___+', 'PHI', 'g')) AS surface_sha FROM marked")
def normalize_variants(spark, d):
    return _marked(spark, d).select("doc_id", F.sha2(tx.encoder_form(F.col("text")), 256).alias("encoder_sha"), F.sha2(tx.surface_form(F.col("text")), 256).alias("surface_sha"))


@query("SELECT 'D' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '-C001' AS label, sha256(text) AS sha, doc_id FROM documents")
def text_hashes(spark, d):
    return table(spark, d, "documents").select(F.format_string("D%04d-C001", F.col("doc_id") % 10000).alias("label"), F.sha2("text", 256).alias("sha"), "doc_id")


@query(r"WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, n AS n_tokens, CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, ceil((n - 510) / 256)::INT) END AS n_windows, CASE WHEN n = 0 THEN 0 ELSE n - 256 * greatest(0, ceil((n - 510) / 256)::INT) END AS last_size FROM t")
def token_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.whitespace_tokens(F.col("text")).alias("t")).withColumn("w", tx.token_windows(F.col("t")))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size("w").alias("n_windows"), F.when(F.size("w") > 0, F.size(F.element_at("w", F.size("w")))).otherwise(0).alias("last_size"))


@query(r"WITH s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 20)) AS chunk FROM documents), j AS (SELECT doc_id, chunk, list_distinct(regexp_extract_all(lower(chunk), '[a-z]{3,}')) AS v FROM s), b AS (SELECT list(word) AS h FROM (SELECT word FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 500)), o AS (SELECT doc_id, CASE WHEN len(v) = 0 THEN 0.0 ELSE len(list_intersect(v, h)) / (len(v) + 500 - len(list_intersect(v, h))) END AS jac FROM j, b), q AS (SELECT quantile_cont(jac, 0.9) AS cutoff FROM o) SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (jac >= cutoff) AS n_kept, round(max(jac), 6) AS best FROM o, q GROUP BY 1")
def chunk_overlap_filter(spark, d):
    vocabulary = [r.word for r in doc_freq_vocab(spark, d).select("word").collect()]  # 500 words: membership is one hash lookup a word
    chunks = table(spark, d, "documents").select("doc_id", F.explode(F.filter(tx.sentences(F.col("text")), lambda x: F.length(x) >= 20)).alias("chunk"))
    words = chunks.select("doc_id", F.array_distinct(tx.words(F.col("chunk"))).alias("v"))
    both = words.select("doc_id", F.size("v").alias("n"), F.size(F.filter("v", lambda x: x.isin(*vocabulary))).alias("k"))
    scored = both.select("doc_id", F.when(F.col("n") == 0, 0.0).otherwise(F.col("k") / (F.col("n") + len(vocabulary) - F.col("k"))).alias("jac"))
    cutoff = scored.agg(F.percentile("jac", F.lit(0.9)).alias("cutoff"))
    return scored.crossJoin(F.broadcast(cutoff)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("jac") >= F.col("cutoff")).alias("n_kept"), F.round(F.max("jac"), 6).alias("best"))


@query()
def section_parse(spark, d):
    """Offsets of the chosen section; SQL has no find-all with offsets."""
    from plumbline.operators.experiments import parsed_sections

    return parsed_sections(_marked(spark, d), "text", least=40).drop("text")


@query()
def sentence_permutation(spark, d):
    """Seeded shuffles of sentences; a shuffle has no SQL form."""
    from plumbline.operators.experiments import permuted_sentences

    rows = permuted_sentences(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", "n_sentences", F.sha2("permuted", 256).alias("permuted_sha"), "same_multiset")
