"""Near-dedup by Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import NO_ID, buffers, drop, keyed_rows, mix, stash, unwrapped, wrapped
from tidewright.llm.components import components
from tidewright.llm.superkmer import word_codes, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 1.1e-4 at 0.8.
BANDS, ROWS = 30, 6
#: Texts of one group that a first pass compares with each other; larger groups are dealt out by hash.
DEAL = 500
_rng = np.random.default_rng(20240307)
_SALTS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _rng.integers(1, 2**63, (2, SHINGLE), dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    if not len(codes):
        return codes
    if len(codes) < SHINGLE:
        return mix(np.array([xxhash.xxh64_intdigest(codes.tobytes(), 5)], np.uint64))
    n = len(codes) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += codes[i : i + n] * _FACTORS[0, i]
    return np.unique(mix(total))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least values of its rows' permutations."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    step = 512
    for i in range(0, len(found), step):
        x = found[i : i + step, None] ^ _SALTS[None, :]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def codes_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a batch, A-Z lower-cased."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:  # about 256 kB at a time: arrays of 8 bytes for each byte stay small
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 18), "right")) - 1)
        part, off = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = words_of(part, off)
        codes, bounds = word_codes(part, starts, ends), np.searchsorted(starts, off)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield codes[a:b]
        i = j


def node_of(codes: np.ndarray) -> int:
    """A hash of all words in order: texts that agree in it are copies."""
    return xxhash.xxh64_intdigest(codes.tobytes(), 3) - 2**63


def keyed(docs: DataFrame) -> DataFrame:
    """``did, one, two, node, keys`` for each of keyed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for codes in codes_of(batch.column(3)):
                nodes.append(node_of(codes))
                keys.append(bands(shingles(codes)).view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(nodes, pa.int64()), lists], ["did", "one", "two", "node", "keys"])

    return docs.select("did", "one", "two", "text").mapInArrow(run, "did long, one long, two long, node long, keys array<long>")


def with_sets(texts: DataFrame) -> DataFrame:
    """``node, root, at, shingles`` from texts (node, root, at, text): the shingle sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [shingles(c).tobytes() for c in codes_of(part.column(3))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(sets, pa.binary())], ["node", "root", "at", "shingles"])

    return texts.select("node", "root", "at", "text").mapInArrow(run, "node long, root long, at long, shingles binary")


def led(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, leader`` of the texts that have an earlier one of ``similarity`` in their group (root, deal) which has none.

    A task holds the sets of a group's leaders alone, and each text is compared with those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            gone = []
            for root, deal, node, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (root, deal) != group:
                    group, leaders = (root, deal), []
                own = np.frombuffer(raw.as_py() if hasattr(raw, "as_py") else raw, np.uint64)
                for other, found in leaders:
                    low, high = sorted((len(own), len(found)))
                    if other == node:  # the same row again
                        break
                    if low + 1e-9 >= similarity * high:
                        both = len(np.intersect1d(own, found, assume_unique=True))
                        if both + 1e-9 >= similarity * (low + high - both):
                            gone.append((node, other))
                            break
                else:
                    leaders.append((node, own))
            a, b = zip(*gone, strict=True) if gone else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "leader"])

    order = ["root", "deal", "at", "node"]
    return sets.repartition("root", "deal").sortWithinPartitions(*order).select("root", "deal", "node", "shingles").mapInArrow(run, "node long, leader long")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, deal: int = DEAL, groups: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id (null ids last); columns stay as they are.

    Texts that share the key of a band are candidates, and connected candidates a group. Within a group a text goes if
    its exact Jaccard similarity with an earlier text that stays is ``similarity`` or more, so no two candidates
    that stay are that alike. A group of over ``deal`` texts is first dealt out by hash and thinned part by part: a
    text may go there for one that goes for a third in the second pass. Copies (equal words) are one text. groups:
    (did, one, two, group) of rows that are candidates besides, and joined: links (a, b) between groups.
    """
    key = ["did", "one", "two"]
    rows = keyed_rows(docs)
    found = stash(keyed(rows), "keys")
    # the order of texts: by doc_id, nulls last, copies by their hashes
    place = F.when(F.col("did") == NO_ID, F.lit(2**63 - 1)).otherwise(F.col("did"))
    nodes = stash(found.groupBy("node").agg(F.min(F.struct(place.alias("at"), *key)).alias("first"), F.first("keys").alias("keys")), "nodes")
    pairs = nodes.select("node", F.explode("keys").alias("key"))
    least = stash(pairs.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1").select("key", "low"), "least")
    links = pairs.join(least, "key").filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    if groups is not None:
        placed = stash(groups.join(found.select(*key, "node"), key).select("group", "node").distinct(), "placed")
        first = stash(placed.groupBy("group").agg(F.min("node").alias("low")), "first")
        links = links.unionByName(placed.join(first, "group").filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")))
        if joined is not None:
            ends = [first.select(F.col("group").alias(c), F.col("low").alias(f"low_{c}")) for c in ("a", "b")]
            links = links.unionByName(joined.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))
    roots = components(links)
    roots = stash(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "roots")
    drop(least)
    again = stash(found.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "again")
    repeats = not again.isEmpty()
    asked = nodes.join(roots, "node").select(*(F.col(f"first.{c}").alias(c) for c in [*key, "at"]), "node", "root")
    texts = rows.select(*key, "text").join(asked, key)
    sets = stash(with_sets(texts.dropDuplicates(["node"]) if repeats else texts), "sets")
    sizes = stash(sets.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    parts = F.expr(f"(n + {deal - 1}) div {deal}")
    dealt = sets.join(sizes, "root").withColumn("deal", F.when(F.col("n") > deal, F.pmod(F.xxhash64("node"), parts)).otherwise(F.lit(0).cast("long")))
    gone = stash(led(dealt, similarity).select("node"), "gone")
    large = sizes.filter(F.col("n") > deal)
    if not large.isEmpty():
        rest = sets.join(large, "root").join(gone, "node", "left_anti").withColumn("deal", F.lit(0).cast("long"))
        gone = stash(gone.unionByName(led(rest, similarity).select("node")), "gone")
    kept = nodes.join(gone, "node", "left_anti").select(*(F.col(f"first.{c}").alias(c) for c in key))
    # what goes is less than what stays, and often small enough to be sent to all
    less = stash(found.select(*key).join(kept, key, "left_anti").distinct(), "less")
    drop(sets, sizes, nodes, found)
    out = wrapped(docs).join(less, key, "left_anti")
    if repeats:
        out = out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates(key))
    return unwrapped(out)
