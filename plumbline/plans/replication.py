"""Queries of reruns, gates, variants and masked pooling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import ranking, vectors
from plumbline.operators import replication as op
from plumbline.plans.base import query, table
from plumbline.plans.vectors import _D, _E, SIGMA

# How a label names a corpus.
CORPORA = {"MIMIC-III": "baseline|mimic.?iii|mimic3", "MIMIC-IV": "target|mimic.?iv|mimic4"}
SIZES, SEEDS = (20, 50, 100), (1, 2)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events) SELECT event_id, rank, CASE WHEN rank <= 50 THEN 'top' WHEN rank >= 2451 THEN 'bottom' ELSE 'middle' END AS band FROM r")
def rank_bands(spark, d):
    ranked = ranking.ranked_by_score(table(spark, d, "events").select("event_id", "value"), "value", "event_id")
    return ranked.select("event_id", "rank", op.rank_band(F.col("rank")).alias("band"))


@query("WITH r AS (SELECT event_type, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events) SELECT event_type, min(rank) AS min_rank, median(rank) AS median_rank, max(rank) AS max_rank, count(*) FILTER (rank <= 50) AS n_top, count(*) FILTER (rank >= 2451) AS n_bottom FROM r GROUP BY 1")
def group_rank_profile(spark, d):
    ranked = ranking.ranked_by_score(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "event_id")
    return op.group_rank_profile(ranked, "event_type", "rank", 50, 2451)


@query("SELECT doc_id, row_number() OVER (ORDER BY nullif(source, (SELECT min(source) FROM documents)) ASC NULLS LAST, doc_id) AS pos FROM documents")
def nulls_last(spark, d):
    """The first source counts as unknown, so that some rows have none."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = docs.crossJoin(F.broadcast(docs.agg(F.min("source").alias("m")))).select("doc_id", F.nullif("source", "m").alias("s"))  # one row
    return ranking.with_positions(rows, [F.col("s").asc_nulls_last(), F.col("doc_id")], "pos", 1).select("doc_id", "pos")


@query("WITH l AS (SELECT lang, ['Baseline window', 'MIMIC III', 'target', 'mimic4 2020'][(doc_id % 4 + 1)::INT] AS label FROM documents) SELECT lang, CASE WHEN regexp_matches(lower(label), 'baseline|mimic.?iii|mimic3') THEN 'MIMIC-III' WHEN regexp_matches(lower(label), 'target|mimic.?iv|mimic4') THEN 'MIMIC-IV' END AS corpus, count(*) AS n FROM l GROUP BY 1, 2")
def corpus_classes(spark, d):
    label = F.element_at(F.array(*map(F.lit, ("Baseline window", "MIMIC III", "target", "mimic4 2020"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("lang", op.corpus_class(label, CORPORA).alias("corpus")).groupBy("lang", "corpus").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id, d.text IS NULL AS text_missing, sha256(d.text) AS sha FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def attached_text(spark, d):
    texts = table(spark, d, "documents").where("lang = 'en'")
    rows = op.attached(table(spark, d, "labels").select("doc_id"), texts, "doc_id", "text")
    return rows.select("doc_id", "text_missing", F.sha2("text", 256).alias("sha"))


@query("WITH s AS (SELECT event_id, CASE WHEN value < 50 THEN 'baseline' ELSE 'target' END AS side FROM events) SELECT event_id, side, row_number() OVER (ORDER BY side, md5(CASE side WHEN 'baseline' THEN '42:' ELSE '200042:' END || event_id), event_id) - 1 AS pos FROM s")
def shuffled_stream(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return op.shuffled_stream(events.where("value < 50"), events.where("value >= 50"), "event_id", 42).drop("value")


@query("""WITH s AS (SELECT event_id, CASE WHEN value < 50 THEN 'baseline' ELSE 'target' END AS side FROM events), g AS (SELECT * FROM (VALUES (20), (50), (100)) a(size), (VALUES (1), (2)) b(seed)),
r AS (SELECT side, seed, size, event_id FROM s, g QUALIFY row_number() OVER (PARTITION BY side, seed, size ORDER BY md5(seed || ':' || size || ':' || event_id), event_id) <= size),
p AS (SELECT side, n, seed, a.size AS size_a, b.size AS size_b FROM (SELECT side, count(*) AS n FROM s GROUP BY 1), (VALUES (1), (2)) c(seed), (VALUES (20), (50), (100)) a(size), (VALUES (20), (50), (100)) b(size) WHERE a.size < b.size),
o AS (SELECT a.side, a.seed, a.size AS size_a, b.size AS size_b, count(*) AS k FROM r a JOIN r b ON a.side = b.side AND a.seed = b.seed AND a.event_id = b.event_id AND a.size < b.size GROUP BY 1, 2, 3, 4)
SELECT side, seed, size_a, size_b, coalesce(k, 0)::BIGINT AS n_shared, round(size_a::DOUBLE * size_b / n, 6) AS expected, coalesce(k, 0) = size_a AS nested FROM p LEFT JOIN o USING (side, seed, size_a, size_b)""")
def sample_overlap(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    out = op.sample_overlaps({"baseline": events.where("value < 50"), "target": events.where("value >= 50")}, "event_id", SIZES, SEEDS)
    return out.withColumn("expected", F.round("expected", 6))


@query("WITH s AS (SELECT doc_id, sha256(text) AS sha FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha END AS sha FROM s WHERE doc_id % 11 <> 0 UNION ALL SELECT -1, 'x') SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' ELSE 'changed' END AS reason FROM s FULL JOIN m USING (doc_id) WHERE s.doc_id IS NULL OR m.doc_id IS NULL OR s.sha <> m.sha")
def provenance_gate(spark, d):
    """Against a manifest with wrong digests, unlisted documents and one that isn't there."""
    found = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    listed = found.where("doc_id % 11 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha")))
    return op.provenance(found, listed.unionByName(spark.createDataFrame([(-1, "x")], "doc_id long, sha string")), "doc_id", "sha")


_REPLAY = "row_number() OVER (PARTITION BY event_type ORDER BY {0} DESC, event_id) AS o FROM events QUALIFY o <= 50"


@query(f"WITH a AS (SELECT event_type, event_id, {_REPLAY.format('value')}), b AS (SELECT event_type, event_id, {_REPLAY.format('CASE WHEN event_id % 10 = 0 THEN value - 1 ELSE value END')}), j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, a.o AS x, b.o AS y FROM a FULL JOIN b ON a.event_type = b.event_type AND a.event_id = b.event_id), c AS (SELECT event_type, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_common, count(*) FILTER (y IS NULL) AS replay_only, count(*) FILTER (x IS NULL) AS saved_only, count(*) FILTER (x <> y) AS moved FROM j GROUP BY 1) SELECT event_type, n_common, replay_only, saved_only, replay_only + saved_only = 0 AS set_match, replay_only + saved_only + moved = 0 AS order_match FROM c")
def selection_replay(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")

    def chosen(value):
        w = Window.partitionBy("event_type").orderBy(F.col("v").desc(), "event_id")
        return events.withColumn("v", value).withColumn("o", F.row_number().over(w)).where("o <= 50")

    changed = F.when(F.col("event_id") % 10 == 0, F.col("value") - 1).otherwise(F.col("value"))
    return op.selection_replay(chosen(F.col("value")), chosen(changed), "event_type", "event_id", "o")


@query(f"WITH {_E}, f AS (SELECT vec_id, base, 1 AS kind, e FROM e UNION ALL SELECT vec_id, base, 2, CASE WHEN vec_id % 4 = 0 THEN list_transform(e, lambda x: x + 0.5) ELSE e END FROM e WHERE base UNION ALL SELECT vec_id, base, 2, e FROM e WHERE NOT base), k AS (SELECT a.kind, a.base AS x, b.base AS y, avg(exp(-{_D} / (2 * {SIGMA} * {SIGMA}))) AS m FROM f a JOIN f b ON a.kind = b.kind AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT kind, max(m) FILTER (x AND y) + max(m) FILTER (NOT x AND NOT y) - 2 * max(m) FILTER (x AND NOT y) AS v FROM k GROUP BY 1) SELECT round(o.v, 6) AS original, round(p.v, 6) AS preferred, round(p.v - o.v, 6) AS absolute_change, round(100 * (p.v - o.v) / o.v, 3) AS relative_change_pct FROM s o, s p WHERE o.kind = 1 AND p.kind = 2")
def baseline_substitution(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    base, target = e.where("label < 5"), e.where("label >= 5")
    preferred = base.withColumn("v", F.when(F.col("vec_id") % 4 == 0, F.transform("v", lambda x: x + 0.5)).otherwise(F.col("v")))
    r = op.substitution(base, preferred, target, "vec_id", "v", SIGMA)
    digits = {"relative_change_pct": 3}
    return spark.createDataFrame([tuple(None if v is None else round(v, digits.get(k, 6)) for k, v in r.items())], "original double, preferred double, absolute_change double, relative_change_pct double")


@query("WITH t AS (SELECT doc_id, text, length(text) // 4 AS s, length(text) // 2 AS e FROM documents), b AS (SELECT *, text[s + 1:e] AS body FROM t), v AS (SELECT *, text[1:s] || regexp_extract(body, '^\\s*') || 'replaced ' || doc_id || regexp_extract(body, '\\s*$') || text[e + 1:] AS variant FROM b WHERE body <> '' AND trim(body, E' \\n\\t\\r') <> '') SELECT doc_id, length(body) AS original_body_length, length('replaced ' || doc_id) AS inserted_filler_length, length(body) + length(variant) - length(text) AS replacement_body_length, length(variant) - length(text) AS note_character_change, '[42,' || doc_id || ']' AS seed_sequence_json, row_number() OVER (ORDER BY doc_id) AS variant_order, sha256(variant) AS variant_sha FROM v".replace("\\\\", "\\"))
def text_variants(spark, d):
    """The second quarter of each text replaced; texts whose second quarter is blank are no hosts."""
    n = F.length("text")
    hosts = table(spark, d, "documents").select("doc_id", "text", F.floor(n / 4).cast("int").alias("s"), F.floor(n / 2).cast("int").alias("e"), F.concat(F.lit("replaced "), F.col("doc_id").cast("string")).alias("filler"))
    hosts = hosts.where(tx.stripped(F.substr("text", F.col("s") + 1, F.col("e") - F.col("s"))) != "")
    out = op.variants(hosts, "text", "s", "e", "filler", "doc_id")
    return out.select("doc_id", "original_body_length", "inserted_filler_length", "replacement_body_length", "note_character_change", "seed_sequence_json", "variant_order", F.sha2("variant_text", 256).alias("variant_sha"))


@query("WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, unnest(generate_series(0, greatest(0, ceil((len(t) - 510) / 256.0)::INT))) AS i, t FROM t WHERE len(t) > 0), p AS (SELECT doc_id, list_avg(list_transform(t[i * 256 + 1:i * 256 + 510], lambda x: length(x))) AS m, len(t[i * 256 + 1:i * 256 + 510]) AS k FROM w) SELECT doc_id, round(avg(m), 6) AS mean_length, count(*) AS n_windows, sum(k)::BIGINT AS n_pooled FROM p GROUP BY 1")
def masked_mean_pooling(spark, d):
    """Windows with their two special tokens and padding; the mean of a token's vector (here its length) leaves both out."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(tx.token_windows(tx.whitespace_tokens(F.col("text")))).alias("w"))
    masks = rows.select("doc_id", tx.padded(F.concat(F.array(F.lit("[CLS]")), "w", F.array(F.lit("[SEP]"))), 512, "[PAD]").alias("t"), tx.pooling_mask(F.col("w"), 512).alias("m"))
    pooled = masks.select("doc_id", tx.masked_mean(F.transform("t", lambda x: F.array(F.length(x).cast("double"))), F.col("m"), 1)[0].alias("x"), F.aggregate("m", F.lit(0), lambda s, v: s + v).alias("k"))
    return pooled.groupBy("doc_id").agg(F.round(F.avg("x"), 6).alias("mean_length"), F.count("*").alias("n_windows"), F.sum("k").alias("n_pooled"))


@query()
def pca_contract(spark, d):
    """The baseline's PCA against its own declaration; a departure raises."""
    pca = vectors.fitted_pca(table(spark, d, "embeddings").where("label < 5"), "embedding")
    k, n = pca["components"].shape
    explained = op.pca_contract(pca, n, k, float(pca["ratio"][:k].sum()), 1e-9)
    return spark.createDataFrame([(n, k, round(explained, 6))], "n_features int, n_components int, explained double")
