"""SimHash near-dedup with Golay-code fuzzy keys."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import jaccard
from tidewright.llm.common import NO_ID, keyed_rows, small_batches, stash, unsigned_hex, unwrapped, wrapped
from tidewright.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket above which it is parted by blocks of the fingerprints.
HOT = 4096
#: Bucket size up to which a bucket's members are compared side by side, without a search.
SMALL = 16
MASK = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text, A-Z lower-cased; 0 without words.

    A bit is 1 if it is set in over half of the shingles' XXH64 hashes, repeats counted.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``did, one, two, doc_id, fp`` for each of keyed rows, fp the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(4)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(fps.view(np.int64))], ["did", "one", "two", "doc_id", "fp"])

    return keyed_rows(docs).mapInArrow(run, "did long, one long, two long, doc_id long, fp long")


def _remainders(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight at most 3; the offsets from the nearest codeword's index to
    the indices of all codewords within distance 4 (one, or six where the error has weight 3; -1 fills up)."""
    patterns = np.array([sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(23), n)])
    errors = np.zeros(2048, np.int64)
    errors[_remainders(patterns)] = patterns
    offsets = np.full((2048, 6), -1, np.int64)
    offsets[:, 0] = 0
    words = np.arange(4096) << 11
    words |= _remainders(words)
    filled = np.ones(2048, np.int64)
    for v in words[np.bitwise_count(words) == 7]:
        bits = [b for b in range(23) if v >> b & 1]
        for c in itertools.combinations(bits, 3):
            s = int(_remainders(np.array([sum(1 << b for b in c)]))[0])
            offsets[s, filled[s]] = v >> 11
            filled[s] += 1
    return errors, offsets


def fuzzy_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each fingerprint: two fingerprints within 4 bits share at least one key.

    Segments of 22, 21 and 21 bits are read as words of the Golay code. Words within 2 bits have a common codeword
    within distance 4 of both (the one nearest to a word between them, as the code is perfect with radius 3). With
    4 errors in three segments at most one segment has 3 or more, so some pair of segments shares both codewords.
    """
    errors, offsets = tables
    each = []
    for low, width in SEGMENTS:
        x = (fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        s = _remainders(x)
        index = (x ^ errors[s]) >> 11
        off = offsets[s]
        each.append(np.where(off >= 0, index[:, None] ^ off, -1))
    keys, rows = [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = each[i][:, :, None], each[j][:, None, :]
        row, p, q = np.nonzero((a >= 0) & (b >= 0))
        keys.append(number << 24 | each[i][row, p] << 12 | each[j][row, q])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def close_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins fingerprints within ``distance``: at most len(fps) - 1 links.

    Breadth first: a reached fingerprint is compared once with all that are not reached yet.
    """
    out = []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                out += [(int(x), int(y)) for y in found]
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links a-b connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_links(keyed: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links that connect, bucket by bucket, all fingerprints of one key within ``distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i in np.flatnonzero(size > SMALL):
                if found := close_links(fp[start[i] : start[i] + size[i]], distance):
                    one, two = zip(*found, strict=True)
                    a.append(np.array(one, np.uint64))
                    b.append(np.array(two, np.uint64))
            small = np.repeat((size > 1) & (size <= SMALL), size)
            key, fp = key[small], fp[small]
            for step in range(1, SMALL):
                near = np.flatnonzero((key[step:] == key[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= distance))
                a.append(fp[near])
                b.append(fp[near + step])
            one, two = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(key) < 1 << 17:
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(key, fp)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def parted(keyed: DataFrame, distance: int) -> DataFrame:
    """keyed (key, fp) with each row once for each of ``distance + 1`` blocks of its fingerprint's bits, which the new key holds.

    Of two fingerprints within the distance at least one block has no differing bit, so they meet again.
    """
    blocks, edges = distance + 1, [64 * i // (distance + 1) for i in range(distance + 2)]
    block = lambda i: F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keys = F.array(*(F.xxhash64("key", F.lit(i), block(i)) for i in range(blocks)))
    return keyed.select(F.explode(keys).alias("key"), "fp")


def linked(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows with their fingerprints (``fp``), the distinct fingerprints with their least doc_id (``fp, least``), and links
    (``a, b``) that connect all fingerprints at most ``distance`` bits apart."""
    if distance > DISTANCE:
        raise ValueError("the keys are exact up to 4 bits")
    rows = stash(fingerprints(docs, shingle), "fingerprints")
    unique = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            all_ = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(all_), 4096):
                fps = all_[i : i + 4096]
                key, row = fuzzy_keys(fps, tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], ["key", "fp"])

    keyed = unique.select("fp").mapInArrow(keys, "key long, fp long")
    hot = stash(keyed.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
    if hot.isEmpty():
        return rows, unique, bucket_links(keyed, distance)
    cool = bucket_links(keyed.join(hot, "key", "left_anti"), distance)
    return rows, unique, cool.unionByName(bucket_links(parted(keyed.join(hot, "key", "left_semi"), distance), distance))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``did, one, two, doc_id, fp, fingerprint, root, component_id`` for each row of docs (doc_id, text; other columns are ignored).

    Fingerprints at most ``distance`` (up to 4) bits apart link; component_id is the smallest doc_id reachable.
    Equal fingerprints are one node from the start, so groups of copies cost one row. Texts that are null, empty
    or blank have fingerprint 0 and link like any other. Rows with a null doc_id link too; component_id is null
    only where no row of the component has an id. Repeated rows give repeated results.
    """
    rows, unique, links = linked(docs, shingle, distance)
    roots = components(links)
    joined = unique.join(roots, unique.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = stash(joined, "linked")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp", "left").select("did", "one", "two", "doc_id", "fp", unsigned_hex(F.col("fp")).alias("fingerprint"), "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (nulls last, ties by hashes of the text).

    Columns stay as they are. Rows are told apart by doc_id and text, so a doc_id that several groups share stays
    in each of them; rows equal in both are one.
    """
    key = ["did", "one", "two"]
    place = F.when(F.col("did") == NO_ID, F.lit(2**63 - 1)).otherwise(F.col("did"))
    found = near_duplicates(docs, shingle, distance).groupBy("root").agg(F.min(F.struct(place.alias("at"), *key)).alias("first"))
    kept = stash(found.select(*(F.col(f"first.{c}").alias(c) for c in key)), "kept")
    return unwrapped(wrapped(docs).join(kept, key, "left_semi").dropDuplicates(key))


def one_of_each_alike(docs: DataFrame, shingle: int = jaccard.SHINGLE, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """docs with one row of each group of texts whose word shingles have a Jaccard similarity of ``similarity``, the smallest doc_id's.

    Fingerprints within 4 bits make candidates by their Golay keys, and exact shingle sets decide. Texts of that similarity may lie
    13 bits apart, beyond what the keys reach, so MinHash bands add candidates (``jaccard.one_of_each``).
    """
    with small_batches(docs.sparkSession):
        rows, _, links = linked(docs, shingle)
        return jaccard.one_of_each(docs, similarity, groups=rows.select("did", "one", "two", F.col("fp").alias("group")), joined=links)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
