"""Substring dedup by one distributed suffix order of a whole corpus: the difference-cover algorithm on tables.

Positions are rows. Those not divisible by three are the sample: their triples are sorted over range partitions and
named, and the names, as two new documents for each document, are ordered by recursion. A triple of triples covers
nine bytes and so on, so the recursion ends once names cover the length asked for. Remaining positions are merged by (code, rank
of the next) against the one class and (code, code, rank of the next but one) against the other; adjacent suffixes
are compared last, across the borders of partitions too.

All that is sorted and joined is one row a position at each level, which is many times the corpus (see the README for figures), so
``substring_bytes.removed_bytes`` deals the corpus out first and sorts suffixes within buckets. This form is for corpora
where a total order is wanted and the room is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import drop, stash
from tidewright.llm.substring_bytes import LENGTH, finished
from tidewright.llm.superkmer import texts_of, window_hashes


def running(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """``keys`` and, for each name, the sum of its column over all rows of strictly smaller keys.

    Rows are summed by key first; keys lie in range partitions, each of which begins where the sums of those before it end.
    """
    summed = rows.groupBy(*keys).agg(*(F.sum(c).alias(name) for name, c in counts.items()))
    placed = stash(summed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "keys")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy("part").agg(*(F.sum(name).alias(name) for name in counts))
    parts = parts.select("part", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"base_{name}") for name in counts))
    sums = [(F.coalesce(F.sum(name).over(inside), F.lit(0)) + F.col(f"base_{name}")).alias(name) for name in counts]
    return placed.join(parts, "part").select(*keys, *sums)


def order(codes: DataFrame, need: int) -> DataFrame:
    """``d, i, r`` for each row of codes (d, i, c; c at least 1): r orders suffixes by their first ``need`` codes, and no suffix
    lies between two that agree in them.

    A suffix ends with its document d; what is behind the end is smaller than any code.
    """
    follow = Window.partitionBy("d").orderBy("i")
    after = lambda c, k: F.coalesce(F.lead(c, k).over(follow), F.lit(0))
    triples = stash(codes.select("d", "i", "c", after("c", 1).alias("c1"), after("c", 2).alias("c2")), "triples")
    sample = triples.filter("i % 3 != 0")
    key = ["c", "c1", "c2"]
    names = running(sample, key, {"r": F.lit(1)})
    named = stash(sample.join(names, key).select("d", "i", (F.col("r") + 1).alias("r")), "named")
    if need > 3:
        lower = named.select((F.col("d") * 3 + F.col("i") % 3).alias("d"), F.expr("i div 3").alias("i"), F.col("r").alias("c"))
        deeper = order(lower, -(-need // 3))
        ranks = deeper.select(F.expr("d div 3").alias("d"), (F.col("i") * 3 + F.col("d") % 3).alias("i"), (F.col("r") + 1).alias("r"))
    else:
        ranks = named
    whole = triples.join(ranks, ["d", "i"], "left").select("d", "i", "c", "c1", "r", after("r", 1).alias("r1"), after("r", 2).alias("r2"), (F.col("i") % 3).alias("class"))
    whole = stash(whole, "whole")
    drop(triples, named)
    has = lambda k: F.when(F.col("class") == k, 1).otherwise(0)
    against_one = stash(running(whole.filter("class != 2"), ["c", "r1"], {"zeros": has(0), "ones": has(1)}), "against_one")
    against_two = stash(running(whole.filter("class != 1"), ["c", "c1", "r2"], {"zeros": has(0), "twos": has(2)}), "against_two")
    zero = whole.filter("class = 0").join(against_one.select("c", "r1", "zeros", "ones"), ["c", "r1"]).join(against_two.select("c", "c1", "r2", "twos"), ["c", "c1", "r2"])
    zero = zero.select("d", "i", (F.col("zeros") + F.col("ones") + F.col("twos")).alias("r"))
    one = whole.filter("class = 1").join(against_one.select("c", "r1", "zeros"), ["c", "r1"]).select("d", "i", (F.col("r") - 1 + F.col("zeros")).alias("r"))
    two = whole.filter("class = 2").join(against_two.select("c", "c1", "r2", "zeros"), ["c", "c1", "r2"]).select("d", "i", (F.col("r") - 1 + F.col("zeros")).alias("r"))
    return stash(zero.unionByName(one).unionByName(two), "order")


def neighbours(rows: DataFrame, value: str) -> DataFrame:
    """rows (r and others) whose ``value`` equals that of the row before or after it in the order of r."""
    ranged = rows.repartitionByRange("r", value).sortWithinPartitions("r", value).withColumn("at", F.monotonically_increasing_id())
    ranged = stash(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    ends = ranged.groupBy("part").agg(F.min_by(value, "at").alias("first"), F.max_by(value, "at").alias("last"))
    along = Window.orderBy("part")  # one row a partition
    ends = ends.select("part", F.lag("last").over(along).alias("left"), F.lead("first").over(along).alias("right"))
    inside = Window.partitionBy("part").orderBy("at")
    joined = ranged.join(ends, "part")
    before, after = F.coalesce(F.lag(value).over(inside), F.col("left")), F.coalesce(F.lead(value).over(inside), F.col("right"))
    near = joined.withColumns({"before": before, "after": after})
    return near.filter(F.coalesce(F.col(value) == F.col("before"), F.lit(False)) | F.coalesce(F.col(value) == F.col("after"), F.lit(False))).select(*rows.columns)


def removed_bytes_by_order(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """As ``substring_bytes.removed_bytes``, by a suffix order of the whole corpus.

    docs: doc_id, text and any other columns (ignored). One row for each input row: a null text is empty; texts
    shorter than ``length`` lose nothing; repeated rows repeat each other; null doc_ids stay null; an empty table gives none.
    """
    texts = texts_of(docs)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for tid, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = press.decompress(z.as_py())
                codes = np.frombuffer(text, np.uint8).astype(np.int64) + 1
                _, place, hashes = window_hashes([text], False, length)
                w = np.zeros(len(codes), np.int64)
                w[place] = hashes.view(np.int64)
                full = np.zeros(len(codes), bool)
                full[place] = True
                for i in range(0, len(codes), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    n = len(codes[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tid)), pa.array(np.arange(i, i + n)), pa.array(codes[part]), pa.array(w[part]), pa.array(full[part])], ["d", "i", "c", "w", "full"])

    spelt = stash(texts.select("tid", "z").mapInArrow(spell, "d long, i long, c long, w long, full boolean"), "spelt")
    # documents number from 1 so that three times a number, level by level, stays a long
    numbers = stash(spelt.select("d").distinct().select("d", F.row_number().over(Window.orderBy("d")).cast("long").alias("number")), "numbers")
    codes = spelt.join(numbers, "d").select(F.col("number").alias("d"), "i", "c")
    ranks = order(codes, length).withColumnRenamed("d", "number").join(numbers, "number").select("d", "i", "r")
    windows = spelt.filter("full").select("d", "i", "w").join(ranks, ["d", "i"])
    # a hash parts windows that differ; where neighbours agree in it their bytes decide
    maybe = stash(neighbours(windows, "w").select("d", "i", "r"), "maybe")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for tid, z, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = press.decompress(z)
                for k in range(0, len(places), 4096):
                    part = places[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([tid] * len(part), pa.int64()), pa.array([p["i"] for p in part], pa.int64()), pa.array([p["r"] for p in part], pa.int64()), pa.array([text[p["i"] : p["i"] + length] for p in part], pa.binary())], ["d", "i", "r", "s"])

    asked = maybe.groupBy("d").agg(F.collect_list(F.struct("i", "r")).alias("places"))
    spelled = texts.select(F.col("tid").alias("d"), "z").join(asked, "d").select("d", "z", "places").mapInArrow(cut, "d long, i long, r long, s binary")
    again = neighbours(spelled, "s").groupBy(F.col("d").alias("tid")).agg(F.collect_list(F.struct(F.col("i").alias("low"), (F.col("i") + length).alias("high"))).alias("spans"))
    return finished(texts.join(again, "tid", "left").select("doc_id", "z", "spans"), with_bytes)
