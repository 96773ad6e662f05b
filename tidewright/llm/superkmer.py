"""Exact detection of windows that occur more than once, by minimiser-partitioned packed strings.

A *unit* is a byte or a word and a *window* is ``length`` consecutive units of one document. Each window is
assigned the leftmost smallest hash among its k-grams (its minimiser), so equal windows always meet under the
same minimiser. Maximal runs of consecutive windows with one minimiser occurrence form a super-k-mer, which travels as
one packed string.

1. ``texts_of``: each row gets a number of its own, written with its compressed text; nothing else identifies it.
2. ``super_kmers``: one scan emits hashes (minimiser, content, place). A pre-aggregated count keeps minimisers that
   occur at least twice; the others cannot repeat.
3. ``packed_strings``: the packed strings of all places left, counted by their bytes, in each batch first.
4. ``judged``: each minimiser's strings are one bucket, where a bucket function (sorted windows, or a suffix array)
   judges windows exactly.
5. ``judged_in_pieces``: a minimiser with very many strings, or bytes of them, is no bucket. Its strings are cut by the
   minimiser's place in the window into a few pieces, dealt out by the bytes that all windows of a piece share; equal
   pieces are one. What is still too large goes window by window (``judged_alone``): windows whose hash occurs twice are
   counted by their bytes.
6. ``repeated``: verdicts return to all places by (minimiser, content). Where two strings share both hashes, a number
   that their bytes decide parts them (``told_apart``).

Hashes only ever deal out work; every verdict rests on a comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, buffers, drop, mix, stash

CHUNK = 1 << 20
POSITION = np.uint64((1 << 21) - 1)
LONG_WORD = 1 << 16
#: Strings of one minimiser above which they are no bucket, and their bytes.
WIDE = 1000
LIMIT = 1 << 20
#: Pieces that a string of such a minimiser is cut into.
PIECES = 8
#: Bytes of strings that are counted in one batch before they are sent on.
HELD = 16 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, CHUNK + (1 << 12))
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = tuple(both)
    return _powers[base]


def _prefix(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _tables(base, len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return sums, inverse


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of all documents in a buffer."""
    space = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[first[first > 0] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        if ends[j - 1] - starts[i] > CHUNK:  # one word alone
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
        else:
            low = starts[i]
            sums, inverse = _prefix(_BYTE[data[low : ends[j - 1]]], _BASES[0])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            for x in np.flatnonzero(b - a > LONG_WORD):
                out[i + x] = xxhash.xxh64_intdigest(data[starts[i + x] : ends[i + x]].tobytes(), 7)
        i = j
    for x in np.flatnonzero(ends - starts > LONG_WORD):
        out[x] = xxhash.xxh64_intdigest(data[starts[x] : ends[x]].tobytes(), 7)
    return out


def runs(codes: np.ndarray, end_of: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of units with codes; ``end_of``: where each unit's document ends. At most CHUNK + length units.

    Returns first window, number of windows, minimiser hash, content hash.
    """
    n, w = len(codes), length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums, inverse = _prefix(codes, _BASES[0])
    grams = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    keys = (grams & ~POSITION) | np.arange(n - k + 1, dtype=np.uint64)
    pad = -len(keys) % w
    blocks = np.concatenate([keys, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    place = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & POSITION).astype(np.int64)
    valid = np.arange(windows) + length <= end_of[:windows]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    count = np.flatnonzero(last) - first + 1
    other, inverse2 = _prefix(codes, _BASES[1])
    stop = first + count - 1 + length
    content = mix((other[stop] - other[first]) * inverse2[first] + count.astype(np.uint64))
    return first, count, grams[place[first]], content


def _scan(data: np.ndarray, offsets: np.ndarray, words: bool, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, minimiser, content) arrays for one batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if words:
            starts, ends = words_of(part, off)
            codes = word_codes(part, starts, ends)
            bounds = np.searchsorted(starts, off)
        else:
            codes, bounds = None, off
        total = int(bounds[-1])
        for a in range(0, max(1, total), CHUNK):  # more than one turn only for a single long document
            b = min(total, a + CHUNK + length - 1)
            unit = codes[a:b] if words else _BYTE[part[a:b]]
            end_of = np.repeat(bounds[1:], np.diff(bounds))[a:b] - a
            first, count, low, content = runs(unit, np.minimum(end_of, b - a), length, k)
            if len(first):
                doc = np.searchsorted(bounds, first + a, "right") - 1
                yield doc + i, first + a - bounds[doc], count, low, content
        i = j


def super_kmers(texts: DataFrame, words: bool, length: int, k: int) -> DataFrame:
    """``tid, first, n, m, content`` for each super-k-mer of texts (tid, z)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, part in opened(batches):
            data, offsets = buffers(pa.array(part, pa.large_binary()))
            for doc, first, count, low, content in _scan(data, offsets, words, length, k):
                yield pa.RecordBatch.from_arrays([pa.array(tid[doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(content.view(np.int64))], ["tid", "first", "n", "m", "content"])

    return texts.select("tid", "z").mapInArrow(scan, "tid long, first int, n int, m long, content long")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Numbers and texts of (tid, z), a few megabytes at a time."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        tid, z = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        begin, size, part = 0, 0, []
        for i in range(len(z)):
            part.append(press.decompress(z[i].as_py()))
            size += len(part[-1])
            if size > 4 * CHUNK:
                yield tid[begin : i + 1], part
                begin, size, part = i + 1, 0, []
        if part:
            yield tid[begin:], part


def texts_of(docs: DataFrame) -> DataFrame:
    """``tid, doc_id, z``: each row with a number of its own and its text compressed (null: empty), as a written table."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [press.compress((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["tid", "doc_id", "z"])

    rows = docs.select(F.monotonically_increasing_id().alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(rows.mapInArrow(squeeze, "tid long, doc_id long, z binary"), "texts")


def _asked(texts: DataFrame, places: DataFrame) -> DataFrame:
    asks = places.groupBy("tid").agg(F.collect_list(F.struct("first", "n", "m", "content")).alias("asks"))
    return texts.select("tid", "z").join(asks, "tid")


def _cuts(batch: pa.RecordBatch, words: bool, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(tid, first, m, content, string) of each place that a batch (tid, z, asks) asks for."""
    press = zstandard.ZstdDecompressor()
    asks = batch.column(2)
    bounds, flat = asks.offsets.to_pylist(), asks.flatten()
    first, n, m, content = (flat.field(c).to_pylist() for c in ("first", "n", "m", "content"))
    base = bounds[0]
    for tid, z, low, high in zip(batch.column(0).to_pylist(), batch.column(1), bounds[:-1], bounds[1:], strict=True):
        text = press.decompress(z.as_py())
        units = text.split() if words else text
        for i in range(low - base, high - base):
            part = units[first[i] : first[i] + n[i] - 1 + length]
            yield tid, first[i], m[i], content[i], b" ".join(part) if words else part


def packed_strings(texts: DataFrame, hits: DataFrame, words: bool, length: int) -> DataFrame:
    """``m, content, s, copies``: the distinct packed strings of all places (tid, first, n, m, content) and how often each occurs.

    Strings are counted in each batch before they are shuffled, so a passage that all documents share travels once a batch.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch in batches:
            for _, _, m, content, s in _cuts(batch, words, length):
                if s in held:
                    held[s][2] += 1
                    continue
                held[s] = [m, content, 1]
                size += len(s)
                if size > HELD:
                    yield _table(held)
                    held, size = {}, 0
        yield _table(held)

    cuts = _asked(texts, hits).mapInArrow(cut, "m long, content long, s binary, copies long")
    return stash(cuts.groupBy("m", "content", "s").agg(F.sum("copies").alias("copies")), "strings")


def _table(held: dict[bytes, list[int]]) -> pa.RecordBatch:
    m, content, copies = zip(*held.values(), strict=True) if held else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(content, pa.int64()), pa.array(list(held), pa.binary()), pa.array(copies, pa.int64())], ["m", "content", "s", "copies"])


def told_apart(texts: DataFrame, hits: DataFrame, strings: DataFrame, words: bool, length: int) -> tuple[DataFrame, DataFrame]:
    """hits and strings with ``v``, a number that parts strings of equal (m, content); where hashes tell all strings apart it is 0."""
    twins = stash(strings.groupBy("m", "content").agg(F.count("*").alias("k")).filter("k > 1").select("m", "content"), "twins")
    if twins.isEmpty():
        drop(twins)
        return hits.withColumn("v", F.lit(0)), strings.withColumn("v", F.lit(0))
    number = F.row_number().over(Window.partitionBy("m", "content").orderBy("s"))
    numbered = stash(strings.join(twins, ["m", "content"], "left_semi").withColumn("v", number), "numbered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                columns = list(zip(*_cuts(batch.slice(i, 64), words, length), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tid", "first", "m", "content", "s"])

    places = _asked(texts, hits.join(twins, ["m", "content"], "left_semi")).mapInArrow(cut, "tid long, first int, m long, content long, s binary")
    places = stash(places.join(numbered, ["m", "content", "s"]).select("tid", "first", "v"), "places")
    zero = F.coalesce("v", F.lit(0)).alias("v")
    return (
        hits.join(places, ["tid", "first"], "left").select("tid", "first", "n", "m", "content", zero),
        strings.join(numbered.select("m", "content", "s", "v"), ["m", "content", "s"], "left").select("m", "content", "s", "copies", zero),
    )


def judged(strings: DataFrame, judge: Callable[[list[bytes], list[int]], list[np.ndarray]], batch_bytes: int) -> DataFrame:
    """``m, content, v, a, b``: runs of repeated windows (first and last, counted in the super-k-mer) of strings (m, content, v, copies, s).

    Buckets are whole in one partition and sorted, so a task holds few of them at a time.
    """
    names = ["m", "content", "v", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, content, v, copies, s = ([] for _ in range(5))
        size = 0

        def flush() -> pa.RecordBatch:
            at, low, high = [], [], []
            for i, again in enumerate(judge(s, copies)):
                edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
                begins = np.flatnonzero(edge == 1)
                at += [i] * len(begins)
                low += begins.tolist()
                high += (np.flatnonzero(edge == -1) - 1).tolist()
            columns = [pa.array([x[i] for i in at], t) for x, t in ((m, pa.int64()), (content, pa.int64()), (v, pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(low, pa.int32()), pa.array(high, pa.int32())], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > batch_bytes and row[0] != m[-1]:
                    yield flush()
                    m, content, v, copies, s = ([] for _ in range(5))
                    size = 0
                for x, y in zip((m, content, v, copies, s), row, strict=True):
                    x.append(y)
                size += len(row[4])
        if s:
            yield flush()

    rows = strings.select("m", "content", "v", "copies", "s")
    return rows.repartition("m").sortWithinPartitions("m").mapInArrow(run, "m long, content long, v int, a int, b int")


def _minimiser_at(part: bytes | list[bytes], m: int, words: bool, k: int) -> int:
    """Place of the minimiser in its super-k-mer: the first gram of that hash, as any before would be the minimiser of the first window."""
    if words:
        data = np.frombuffer(b" ".join(part), np.uint8)
        codes = word_codes(data, *words_of(data, np.array([0, len(data)])))
    else:
        codes = _BYTE[np.frombuffer(part, np.uint8)]
    sums, inverse = _prefix(codes, _BASES[0])
    grams = mix((sums[k:] - sums[:-k]) * inverse[: len(codes) - k + 1])
    return int(np.flatnonzero(grams.view(np.int64) == m)[0])


def pieces(s: bytes, m: int, words: bool, length: int, k: int) -> Iterator[tuple[int, int, bytes]]:
    """``bucket, skip, piece``: a string's windows parted by the minimiser's place in them.

    All windows of a piece contain the units that its first and last possible window share; a hash of those is the bucket, so
    equal windows meet again. ``skip``: windows of the string before the piece.
    """
    units, join = (s.split(b" "), b" ".join) if words else (s, bytes)
    places, n = length - k + 1, len(units) - length + 1
    at = _minimiser_at(units, m, words, k)
    for p in range(PIECES):
        low, high = -(-p * places // PIECES), -(-(p + 1) * places // PIECES) - 1
        first, last = max(0, at - high), min(n - 1, at - low)
        if low <= high and first <= last:
            shared = join(units[at - low : at - high + length])
            yield xxhash.xxh64_intdigest(shared, 16 + p) - 2**63, first, join(units[first : last + length])


def judged_in_pieces(strings: DataFrame, judge: Callable, batch_bytes: int, limit: int, words: bool, length: int, k: int) -> DataFrame:
    """``judged`` for minimisers whose strings are too many for one bucket."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["m", "content", "v", "copies", "bucket", "skip", "s"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = [(m, content, v, copies, *piece) for m, content, v, copies, s in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns), strict=True) for piece in pieces(s, m, words, length, k)]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    parts = strings.select("m", "content", "v", "copies", "s").mapInArrow(cut, "m long, content long, v int, copies long, bucket long, skip int, s binary")
    parts = stash(parts, "pieces")
    distinct = parts.groupBy("bucket", "s").agg(F.sum("copies").alias("copies"))
    distinct = stash(distinct.withColumn("piece", F.monotonically_increasing_id()), "distinct")
    owners = stash(parts.join(distinct.select("bucket", "s", "piece"), ["bucket", "s"]).select("m", "content", "v", "skip", "piece"), "owners")
    drop(parts)
    rows = distinct.select(F.col("bucket").alias("m"), F.col("piece").alias("content"), F.lit(0).alias("v"), "s", "copies")
    wide = stash(too_wide(rows, limit), "crowds")
    found = judged(rows.join(wide, "m", "left_anti"), judge, batch_bytes)
    if not wide.isEmpty():
        found = found.unionByName(judged_alone(rows.join(wide, "m", "left_semi"), words, length))
    found = stash(found.select(F.col("content").alias("piece"), "a", "b"), "found")
    return owners.join(found, "piece").select("m", "content", "v", (F.col("a") + F.col("skip")).alias("a"), (F.col("b") + F.col("skip")).alias("b"))


def too_wide(strings: DataFrame, limit: int) -> DataFrame:
    """The minimisers (m) whose strings are more, or have more bytes, than a bucket may hold."""
    sizes = strings.groupBy("m").agg(F.count("*").alias("strings"), F.sum(F.octet_length("s")).alias("bytes"))
    return sizes.filter((F.col("strings") > WIDE) | (F.col("bytes") > limit)).select("m")


def window_hashes(strings: list[bytes], words: bool, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, hash) of every window of the strings."""
    data, offsets = buffers(pa.array(strings, pa.large_binary()))
    if words:
        starts, ends = words_of(data, offsets)
        codes, bounds = word_codes(data, starts, ends), np.searchsorted(starts, offsets)
    else:
        codes, bounds = _BYTE[data], offsets
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = bounds[owner] + place
    sums, inverse = _prefix(codes, _BASES[1])
    return owner, place, mix((sums[at + length] - sums[at]) * inverse[at] + np.uint64(length))


def judged_alone(strings: DataFrame, words: bool, length: int) -> DataFrame:
    """``judged`` window by window: a window is dealt out by its own hash, and counted by its bytes where the hash occurs twice."""
    strings = stash(strings, "wide")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                owner, place, w = window_hashes(part.column(4).to_pylist(), words, length)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner)) for c in range(4)), pa.array(place.astype(np.int32)), pa.array(w.view(np.int64))], ["m", "content", "v", "copies", "a", "w"])

    every = strings.select("m", "content", "v", "copies", "s").mapInArrow(hashes, "m long, content long, v int, copies long, a int, w long")
    every = stash(every, "windows")
    twice = stash(every.groupBy("w").agg(F.sum("copies").alias("times")).filter("times > 1").select("w"), "twice")
    maybe = stash(every.join(twice, "w").select("m", "content", "v", "a", "w"), "maybe")
    drop(every, twice)

    def asked(places: DataFrame) -> DataFrame:
        asks = places.groupBy("m", "content", "v").agg(F.collect_list(F.struct("a", "w")).alias("asks"))
        return strings.join(asks, ["m", "content", "v"]).select("m", "content", "v", "copies", "s", "asks")

    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for m, content, v, copies, s, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            units = s.split(b" ") if words else s
            for ask in asks:
                part = units[ask["a"] : ask["a"] + length]
                yield m, content, v, ask["a"], copies, ask["w"], b" ".join(part) if words else part

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def table() -> pa.RecordBatch:
            w, copies = zip(*held.values(), strict=True) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(list(held), pa.binary()), pa.array(copies, pa.int64())], ["w", "s", "copies"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for *_, copies, w, s in windows(batch.slice(i, 64)):
                    held.setdefault(s, [w, 0])[1] += copies
                if len(held) * length > HELD:
                    yield table()
                    held.clear()
        yield table()

    same = asked(maybe).mapInArrow(counted, "w long, s binary, copies long").groupBy("w", "s").agg(F.sum("copies").alias("copies"))
    same = stash(same, "same")
    shared = stash(same.groupBy("w").agg(F.count("*").alias("k"), F.max("copies").alias("most")), "shared")
    verdicts = maybe.join(shared.filter("k = 1 AND most > 1").select("w"), "w").select("m", "content", "v", "a", F.col("a").alias("b"))
    twins = shared.filter("k > 1 AND most > 1").select("w")
    if twins.isEmpty():
        return verdicts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                columns = list(zip(*((m, c, v, a, w, s) for m, c, v, a, _, w, s in windows(batch.slice(i, 64))), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["m", "content", "v", "a", "w", "s"])

    apart = asked(maybe.join(twins, "w", "left_semi")).mapInArrow(cut, "m long, content long, v int, a int, w long, s binary")
    apart = apart.join(same.filter("copies > 1"), ["w", "s"]).select("m", "content", "v", "a", F.col("a").alias("b"))
    return verdicts.unionByName(apart)


def repeated(docs: DataFrame, words: bool, length: int, k: int, judge: Callable, batch_bytes: int, limit: int = LIMIT) -> DataFrame:
    """``doc_id, z, spans``: each row of docs with its compressed text and the unit ranges (end exclusive) of repeated windows.

    limit: bytes of a minimiser's distinct strings above which they are cut into pieces.
    """
    texts = texts_of(docs)
    kmers = stash(super_kmers(texts, words, length, k), "kmers")
    # a table of its own, so that both sides of the join are plain exchanges and a hot minimiser's rows can be split
    often = stash(kmers.groupBy("m").agg(F.count("*").alias("times")).filter("times > 1").select("m"), "often")
    hits = stash(kmers.join(often, "m").select("tid", "first", "n", "m", "content"), "hits")
    drop(kmers, often)
    places, strings = told_apart(texts, hits, packed_strings(texts, hits, words, length), words, length)
    wide = stash(too_wide(strings, limit), "wide")
    found = judged(strings.join(wide, "m", "left_anti"), judge, batch_bytes)
    if not wide.isEmpty():
        found = found.unionByName(judged_in_pieces(strings.join(wide, "m", "left_semi"), judge, batch_bytes, limit, words, length, k))
    verdicts = stash(found, "verdicts")
    drop(wide)
    spans = (
        places.join(verdicts, ["m", "content", "v"])
        .select("tid", (F.col("first") + F.col("a")).alias("low"), (F.col("first") + F.col("b") + length).alias("high"))
        .groupBy("tid")
        .agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    )
    return texts.join(spans, "tid", "left").select("doc_id", "z", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted disjoint ranges, touching ones joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out
