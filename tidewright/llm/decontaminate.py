"""Benchmark decontamination: the q-gram lemma in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import NO_ID, keyed_rows, stash, without

Q = 8
#: Share of an item's characters that may be edited.
BUDGET = 0.1
#: Characters of benchmark items that one pass over the documents takes (what is broadcast is bounded by this).
PASS_CHARS = 4 << 20
CHUNK = 1 << 20
#: Pairs of equal grams that are counted at a time.
PAIRS = 1 << 21
#: Bits of a band's number, and the number of band 0: texts of up to 2^28 characters, and items as long as a pass, fit.
BAND_BITS, BAND_ZERO = 29, 1 << 26
_NOISE = re.compile(r"[\W_]+")
_TABLE = 1 << 20


def normal(text: str | None) -> str:
    """Lower case; every run of characters that are neither letters nor digits is one space."""
    return _NOISE.sub(" ", (text or "").lower()).strip()


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for each run of q units, q at most Q."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    if q == Q:
        quads = np.ndarray((len(codes) - 3,), "<u8", np.ascontiguousarray(codes), strides=(2,))
        x = quads[:-4] * np.uint64(0x9E3779B97F4A7C15) + quads[4:] * np.uint64(0xD1342543DE82EF95)
    else:
        n, x = len(codes) - q + 1, np.zeros(len(codes) - q + 1, np.uint64)
        for i in range(q):
            x = (x + codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Table:
    """An index from grams of q units to (item, place)."""

    q: int
    keys: np.ndarray
    begins: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    seen: np.ndarray


@dataclass
class Items:
    """Benchmark items of one pass: units, edit budgets, least counts of shared grams, and an index for each width of grams.

    ``short``: the items of under Q characters, each between two spaces.
    """

    ids: list
    codes: list
    budgets: np.ndarray
    needs: np.ndarray
    tables: list[Table]
    short: Items | None = None


def index(rows: list[tuple], budget: float) -> Items:
    """The q-gram lemma: an occurrence with at most e edits keeps n - q + 1 - q e of an item's n - q + 1 grams.

    q is Q, or less for items of which at least one gram of Q units need not be kept.
    """
    codes = [units(t) for _, t in rows]
    n = np.array([len(c) for c in codes], np.int64)
    budgets = (n * budget).astype(np.int64)
    widths = np.minimum(Q, n // (budgets + 1))
    tables = []
    for q in np.unique(widths[n > 0]).tolist():
        own = np.flatnonzero(widths == q)
        all_ = [grams(codes[i], q) for i in own]
        keys = np.concatenate(all_)
        owners = np.repeat(own, [len(g) for g in all_])
        places = np.concatenate([np.arange(len(g)) for g in all_]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        unique, begins = np.unique(keys[order], return_index=True)
        seen = np.zeros(_TABLE, bool)
        seen[(unique >> np.uint64(44)).astype(np.int64)] = True
        tables.append(Table(q, unique, np.append(begins, len(keys)), owners[order], places[order], seen))
    return Items([i for i, _ in rows], codes, budgets, n - widths + 1 - widths * budgets, tables)


def candidates(text: np.ndarray, bounds: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, band) of diagonal bands that share enough grams; text: documents end to end, cut at bounds.

    A band of item i is 2 (e + 1) diagonals wide and begins every e + 1, so the diagonals of an occurrence with at
    most e edits, which span at most e, lie in one band.
    """
    found = [_candidates(text, bounds, items, t) for t in items.tables]
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


def _candidates(text: np.ndarray, bounds: np.ndarray, items: Items, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = grams(text, table.q)
    at = np.flatnonzero(table.seen[(g >> np.uint64(44)).astype(np.int64)])
    k = np.searchsorted(table.keys, g[at])
    k[k == len(table.keys)] = 0
    hit = table.keys[k] == g[at]
    at, k = at[hit], k[hit]
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + table.q <= bounds[doc + 1]
    at, k, doc = at[inside], k[inside], doc[inside]
    times = table.begins[k + 1] - table.begins[k]
    total = np.concatenate([[0], np.cumsum(times)])
    keys, counts, i = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while i < len(at):
        # a gram that text and items repeat gives very many pairs, so they are counted in slices
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        part = slice(i, j)
        flat = np.arange(total[j] - total[i]) + np.repeat(table.begins[k[part]] - (total[i:j] - total[i]), times[part])
        item = table.owners[flat]
        diagonal = np.repeat(at[part] - bounds[doc[part]], times[part]) - table.places[flat]
        band = diagonal // (items.budgets[item] + 1)
        key = (np.repeat(doc[part], times[part]) * len(items.ids) + item) << BAND_BITS | (band + BAND_ZERO)
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        if len(keys):
            key, where = np.unique(np.concatenate([keys, key]), return_inverse=True)
            count = np.bincount(where, weights=np.concatenate([counts, count])).astype(np.int64)
        keys, counts, i = key, count, j
    item = (keys >> BAND_BITS) % len(items.ids)
    good = counts >= items.needs[item]
    keys, item = keys[good], item[good]
    return (keys >> BAND_BITS) // len(items.ids), item, (keys & (1 << BAND_BITS) - 1) - BAND_ZERO


def masks(item: np.ndarray) -> dict[int, int]:
    """For each unit the places where the item has it, as bits."""
    out: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        out[c] = out.get(c, 0) | 1 << i
    return out


def within(places: dict[int, int], n: int, text: list[int], budget: int) -> bool:
    """Whether an item of n units lies anywhere in text with at most ``budget`` edits (Myers' bit vectors, one integer a column).

    A banded alignment needs as many edits or more, so what fails here needs none.
    """
    whole, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = whole, 0, n
    for c in text:
        same = places.get(c, 0)
        x = same | down
        same |= ((same & up) + up) ^ up
        rise, fall = down | whole & ~(same | up), up & same
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
            if edits <= budget:
                return True
        rise, fall = rise << 1 & whole, fall << 1 & whole
        up, down = fall | whole & ~(x | rise), rise & x
    return edits <= budget


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the whole item in text along diagonals low - budget to low + width + budget.

    Row by row over the item; gaps in the item's favour run along a row and are a running minimum. None if every
    alignment needs more than ``budget`` edits.
    """
    shift = low - budget
    wide = width + 2 * budget + 1
    lanes = np.arange(wide)
    padded = np.concatenate([np.full(max(0, -shift) + 1, 1 << 17), text.astype(np.int32), np.full(len(item) + wide + 2, 1 << 17)])
    base = shift + max(0, -shift) + 1
    cost = np.zeros(wide, np.int64)
    cost[(lanes + shift < 0) | (lanes + shift > len(text))] = 1 << 20
    came = lanes + shift
    for i, c in enumerate(item):
        # lane d stands for text place i + d + shift; from row to row a lane keeps its diagonal
        step = cost + (padded[base + i : base + i + wide] != c)
        skip = np.append(cost[1:], 1 << 20) + 1
        cost_from = np.where(step <= skip, came, np.append(came[1:], 0))
        best = np.minimum(step, skip)
        run = best - lanes
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, lanes, -1))
        cost, came = least + lanes, cost_from[source]
        if cost.min() > budget:
            return None
    end = len(item) + lanes + shift
    cost = np.where((end < 0) | (end > len(text)), 1 << 20, cost)
    x = int(np.argmin(cost))
    return (int(cost[x]), int(came[x]), int(end[x])) if cost[x] <= budget else None


def matches(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every verified region of normalised texts; one for each band at most.

    Items of under Q characters (numbered after the others) are found as whole words only.
    """
    if items.short:
        for text, item, start, end, _ in matches([f" {t} " for t in texts], items.short):
            yield text, len(items.codes) + item, start, end - 2, 0
    i, known = 0, {}
    while i < len(texts):
        part, size = [], 0
        j = i
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            part.append(units(texts[j]))
            size += len(texts[j])
            j += 1
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in part])])
        # the padding keeps 8-byte reads inside
        flat = np.concatenate([*part, np.zeros(Q, np.uint16)])
        for doc, item, band in zip(*candidates(flat, bounds, items), strict=True):
            code, e = items.codes[item], int(items.budgets[item])
            low = int(band) * (e + 1)
            begin = max(0, low - e)
            region = part[doc][begin : max(0, low + 3 * (e + 1) + len(code) + e)]
            place = region.tobytes().find(code.tobytes())
            if place >= 0 and place % 2 == 0:
                yield i + int(doc), int(item), begin + place // 2, begin + place // 2 + len(code), 0
                continue
            if item not in known:
                known[item] = masks(code)
            if within(known[item], len(code), region.tolist(), e) and (found := align(code, region, low - begin, 2 * (e + 1), e)):
                yield i + int(doc), int(item), begin + found[1], begin + found[2], found[0]
        i = j


def passes(benchmark: DataFrame, budget: float) -> Iterator[Items]:
    """The benchmark in bounded blocks; items that are empty once normalised take no part."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = normal(r[1])
        if not text:
            continue
        rows.append((r[0], text))
        size += len(text)
        if size >= PASS_CHARS:
            yield block_of(rows, budget)
            rows, size = [], 0
    if rows:
        yield block_of(rows, budget)


def block_of(rows: list[tuple], budget: float) -> Items:
    """Items (id, normalised text) of any length above 0."""
    items = index([r for r in rows if len(r[1]) >= Q], budget)
    if short := [(i, f" {t} ") for i, t in rows if len(t) < Q]:
        items.short = index(short, 0.0)
    return items


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id, one, two, item_id, start, end, edits, item_chars``: regions of docs within an item's edit budget.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Places are characters of the
    normalised text (``normal``). A null text is empty and holds nothing; repeated documents or items repeat their
    rows; null ids stay null. Regions are the best alignments of each band, overlapping bands' equal ones once. Items of
    under 8 characters are found as whole words without edits. ``one, two`` stand for the text.

    The benchmark is read in blocks of bounded size, one pass over the documents for each; if there are several, each
    pass is written before the next block is built, so one block is in memory at a time.
    """
    rows = keyed_rows(docs).select("doc_id", "one", "two", "text")
    names = ["doc_id", "one", "two", "item_id", "start", "end", "edits", "item_chars"]
    schema = "doc_id long, one long, two long, item_id long, start long, end long, edits int, item_chars int"
    spark = docs.sparkSession
    out, last = spark.createDataFrame([], schema), None
    for items in passes(benchmark, budget):
        if last:
            out = out.unionByName(stash(last[0], "leaks"))
            last[1].destroy()
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            ids = own.ids + (own.short.ids if own.short else [])
            chars = [len(c) for c in own.codes] + ([len(c) - 2 for c in own.short.codes] if own.short else [])
            for batch in batches:
                found = sorted(set(matches([normal(t.as_py()) for t in batch.column(3)], own)))
                at = pa.array([f[0] for f in found], pa.int64())
                item = [f[1] for f in found]
                columns = [*(batch.column(c).take(at) for c in range(3)), pa.array([ids[x] for x in item], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int32()), pa.array([chars[x] for x in item], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

        last = rows.mapInArrow(run, schema), shared
    return out.unionByName(last[0]) if last else out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """docs without those that hold a benchmark item; columns stay as they are, whatever their names.

    Rows that agree in doc_id and text share one fate. Null texts and rows without an id are fine; an empty
    benchmark takes nothing.
    """
    marked = leaks(docs, benchmark, budget)
    return without(docs, marked.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "one", "two").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count("*").alias("regions"), F.min("start").alias("start"), F.max("end").alias("end"))
