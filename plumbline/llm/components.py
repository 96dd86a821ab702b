"""Connected components by alternating large-star and small-star rounds, on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, lean


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition reduced to one link per document to the smallest it meets here."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        pairs = np.array([(find(x), x) for x in root if find(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links (a, b)`` to ``(doc, comp)``: the smallest id in each document's component.

    Documents without links are absent. Each round sends every neighbour of a document to the
    smallest one known; the largest group only ever meets in a pre-aggregated minimum and in a
    join that Spark can split. Lineage is cut in the shared folder after each round.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut(edges.mapInArrow(lean(_forest), "a long, b long").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: larger neighbours of a document are sent to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a document and its smaller neighbours are sent to the smallest of them
        low = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("b").alias("doc"), F.col("a").alias("comp"))
        before = mark
    raise RuntimeError("links did not settle")
