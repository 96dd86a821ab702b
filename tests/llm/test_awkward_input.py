"""Awkward input for each operator on documents: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_extract, jaccard_join, license_scan, mixing, quality, span_dedup, winnow

LONG = " ".join(f"w{k * 7919 % 10007}{'.' if k % 9 == 8 else ''}" for k in range(150_000))  # 1 MB
#: Names that the operators use inside.
NAMES = (
    "row hit items n_words doc h at src bucket size source_size target taken whole edge part _source _edge _part _src _bucket _text _hit _items _n_words _doc _h _at _keep _p_reject _p_weak "
    "_n_removed _n_sentences keep p_reject p_weak a b n gone component_id blob key path license own_license dir leaf z halo host"
).split()
OPERATORS = {
    "1": lambda s, d: mixing.mixed(d),
    "4": lambda s, d: quality.judged(d, s.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")),
    "4k": lambda s, d: quality.kept(d, s.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")),
    "5": lambda s, d: decontaminate.mark_contaminated(d, s.createDataFrame([(1, "w0 w7919 w5831"), (None, None)], "item_id long, text string")),
    "6": lambda s, d: winnow.fingerprint_report(d),
    "7": lambda s, d: span_dedup.span_report(d),
    "9": lambda s, d: jaccard_join.jaccard_components(d),
    "3": lambda s, d: license_scan.document_licenses(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "s"), (2, "one two three four five six", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \n", "en", "t"), (6, LONG, "en", "t"), (6, LONG, "en", "t"), (7, LONG + " x", "de", None), (None, "one two", "en", "s"), (None, None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


@pytest.mark.parametrize("n", OPERATORS)
def test_awkward(spark, docs, n):
    got = OPERATORS[n](spark, docs)
    rows = got.collect()
    assert len(rows) == docs.count() if n != "4k" else set(got.columns) == set(docs.columns)
    whole = [r["row"] for r in rows if n in ("4", "5", "7")]
    assert all(r[name] == k for r in whole for k, name in enumerate(NAMES))
    assert OPERATORS[n](spark, docs.limit(0)).collect() == []
    again = OPERATORS[n](spark, docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_awkward_pages(spark):
    rows = [(1, "http://h/a", "<p>x</p>"), (1, "http://h/a", "<p>x</p>"), (2, "http://h/b", None), (3, None, ""), (None, "http://h/a", "<p>y"), (4, "http://h/c", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    got = html_extract.main_text(pages).collect()
    assert len(got) == len(rows) and sorted(map(str, html_extract.main_text(pages.repartition(5)).collect())) == sorted(map(str, got))
    assert max(r.n_chars for r in got) == len(LONG)


def test_awkward_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    plain = docs.drop("size", "source_size", "target", "taken")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert at.columns[: len(plain.columns)] == plain.columns, name
    assert {r.doc_id for r in at.collect()} <= {1, 6, None}
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
