"""Exact top-k inner products: a ball tree for each shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import fresh_path, stash

K = 10
SHARD = 8192
#: Queries that a task holds; every block of them goes past the trees once.
QUERY_BLOCK = 1 << 16
LEAF = 128
#: Each round searches so many times the shards of the one before.
GROWTH = 8
NO_FLOOR = -(2**63)


class BallTree:
    """Balls over vectors of whole numbers; a leaf holds up to LEAF of them. Nodes lie in one array, the two children of a node side by side."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        order = np.arange(len(points))
        lows, highs, children, centres, radii = [0], [len(points)], [0], [None], [0.0]
        node = 0
        while node < len(lows):
            low, high = lows[node], highs[node]
            own = order[low:high]
            centre = points[own].mean(axis=0)
            away = np.sqrt(((points[own] - centre) ** 2).sum(axis=1))
            centres[node], radii[node] = centre, float(away.max())
            if high - low > LEAF and away.max() > 0:
                one = points[own[away.argmax()]]
                two = points[own[((points[own] - one) ** 2).sum(axis=1).argmax()]]
                order[low:high] = own[np.argsort(points[own] @ (two - one), kind="stable")]
                middle = (low + high) // 2
                children[node] = len(lows)
                lows += [low, middle]
                highs += [middle, high]
                children += [0, 0]
                centres += [None, None]
                radii += [0.0, 0.0]
            node += 1
        self.points, self.ids, self.numbers = points[order], ids[order], numbers[order]
        self.lows, self.highs, self.children = np.array(lows), np.array(highs), np.array(children)
        self.centres, self.radii = np.array(centres), np.array(radii)
        self._finish()

    def _finish(self) -> None:
        # what rounding may take from a bound, for a query of norm one
        self.slack = 1e-9 * (np.abs(self.centres).sum(axis=1) + self.radii + 1)
        self.most = float(np.abs(self.points).max(initial=0))
        self.visited = 0

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in ("points", "ids", "numbers", "lows", "highs", "children", "centres", "radii")})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        for name, value in np.load(io.BytesIO(data)).items():
            setattr(tree, name, value)
        tree._finish()
        return tree

    def search(self, query: np.ndarray, number: int, best: Best) -> None:
        """Add to ``best`` what this tree holds for a query; nodes go by descending upper bound of their inner products.

        A node below the k-th score so far ends the search, with all below it unvisited; equal scores stay in, as ties go
        to the smaller id. ``number``: the query's own row, which is no candidate.
        """
        norm = float(np.sqrt((query**2).sum()))
        exact = whole(self.points, query, self.most)
        ask = exact_type(query, exact)
        up = lambda a, b: self.centres[a:b] @ query + norm * (self.radii[a:b] + self.slack[a:b]) + 1e-6
        open_ = [(-float(up(0, 1)[0]), 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < best.floor:
                return
            self.visited += 1
            if child := int(self.children[node]):
                for i, x in enumerate(up(child, child + 2).tolist()):
                    if x >= best.floor:
                        heapq.heappush(open_, (max(-x, bound), child + i))
                continue
            low, high = self.lows[node], self.highs[node]
            scores = exact_type(self.points[low:high], exact) @ ask
            good = np.flatnonzero((scores >= best.floor) & (self.numbers[low:high] != number))
            if len(good):
                best.add([int(x) for x in scores[good]], self.ids[low:high][good].tolist())


def whole(points: np.ndarray, query: np.ndarray, most: float) -> str:
    """The kind of number in which all products with the query are exact."""
    size = len(query) * most * float(np.abs(query).max(initial=0))
    return "float" if size < 2**52 else "long" if size < 2**62 else "object"


def exact_type(x: np.ndarray, kind: str) -> np.ndarray:
    return x if kind == "float" else x.astype(np.int64) if kind == "long" else np.frompyfunc(int, 1, 1)(x)


class Best:
    """The k best (score, id) of a query so far; ties go to the smaller id. ``floor``: what a score must reach."""

    def __init__(self, k: int, floor: int = NO_FLOOR):
        self.k, self.floor, self.found = k, -np.inf if floor == NO_FLOOR else floor, []

    def add(self, scores: list[int], ids: list[int]) -> None:
        self.found = heapq.nsmallest(self.k, self.found + [(-s, i) for s, i in zip(scores, ids, strict=True)])
        if len(self.found) == self.k:
            self.floor = max(self.floor, -self.found[-1][0])


def _write(path: str, data: bytes) -> None:
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def _read(path: str) -> bytes:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        return file.read()


def _points(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.array(vectors.tolist(), float).reshape(len(vectors), -1))


def top_k(vectors: DataFrame, is_query: str, k: int = K, shard_rows: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows by integer inner product.

    vectors: vec_id, embedding (array); other columns are ignored. Components become floor(1024 * x). Every row for
    which ``is_query`` (an SQL condition on vec_id) holds is a query, against every row but itself; repeated rows are
    queries and candidates of their own. Ties go to the smaller vec_id (null first). Vectors that are null or
    hold null or non-finite components take no part; vectors of different lengths have no product. Products are exact at
    any size; a result whose score does not fit a long is an error.

    Rows are dealt to shards by hash of a number that is written with them. A shard's tree is written once, as are blocks of queries; a
    task reads a block and takes the trees of a run of shards one after the other, so the k-th scores pass from tree
    to tree. Shards are searched in rounds that grow by ``GROWTH``, the first of one shard, and after each round all k-th
    scores so far are shared. The table is read once for each block of ``QUERY_BLOCK`` queries and nothing of it is shuffled again.
    """
    spark = vectors.sparkSession
    usable = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable)
    rows = rows.select("vec_id", F.expr("transform(embedding, x -> 1024 * cast(x AS double))").alias("v"), F.expr(f"coalesce({is_query}, false)").alias("asks"))
    rows = stash(rows.withColumns({"dim": F.size("v"), "n": F.monotonically_increasing_id()}), "vectors")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).first()
    shards, blocks = max(1, -(-counts.rows // shard_rows)), max(1, -(-counts.queries // QUERY_BLOCK))
    folder = fresh_path(spark, "trees")
    kind = "dim int, number int, path string"

    def plant(x: pd.DataFrame) -> pd.DataFrame:
        dim, shard = int(x["dim"].iloc[0]), int(x["number"].iloc[0])
        path = f"{folder}/tree-{dim}-{shard}-{uuid.uuid4().hex}"
        ids = x["vec_id"].astype("Int64").fillna(NO_FLOOR).to_numpy(np.int64)
        _write(path, BallTree(_points(x["v"]), ids, x["n"].to_numpy(np.int64)).save())
        return pd.DataFrame({"dim": [dim], "number": [shard], "path": [path]})

    def block(x: pd.DataFrame) -> pd.DataFrame:
        dim, number = int(x["dim"].iloc[0]), int(x["number"].iloc[0])
        path, out = f"{folder}/queries-{dim}-{number}-{uuid.uuid4().hex}", io.BytesIO()
        np.savez(out, points=_points(x["v"]), numbers=x["n"].to_numpy(np.int64))
        _write(path, out.getvalue())
        return pd.DataFrame({"dim": [dim], "number": [number], "path": [path]})

    dealt = lambda df, parts: df.withColumn("number", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")).groupBy("dim", "number")
    trees = stash(dealt(rows, shards).applyInPandas(plant, kind), "trees")
    asked = stash(dealt(rows.filter("asks"), blocks).applyInPandas(block, kind), "blocks").select("dim", F.col("number").alias("block"), F.col("path").alias("queries"))
    at_once = 4 * spark.sparkContext.defaultParallelism

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, number, queries, paths, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given = np.load(io.BytesIO(_read(queries)))
                known = {f["n"]: f["floor"] for f in floors or ()}
                points, numbers = given["points"], given["numbers"].tolist()
                best = [Best(k, known.get(n, NO_FLOOR)) for n in numbers]
                for path in paths:
                    tree = BallTree.load(_read(path))
                    for i, n in enumerate(numbers):
                        tree.search(points[i], n, best[i])
                for i in range(0, len(numbers), 8192):
                    found = [(dim, number, n, x, -s) for n, b in zip(numbers[i : i + 8192], best[i : i + 8192], strict=True) for s, x in b.found]
                    fit = lambda s: s if -(2**63) <= s < 2**63 else None
                    dims, block_, n, ids, scores = zip(*found, strict=True) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(block_, pa.int32()), pa.array(n, pa.int64()), pa.array([None if x == NO_FLOOR else x for x in ids], pa.int64()), pa.array([fit(s) for s in scores], pa.int64()), pa.array([s >= 2**63 for s in scores], pa.bool_())], ["dim", "block", "n", "vec_id", "score", "beyond"])

    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("beyond"), F.desc_nulls_last("score"), F.asc_nulls_first("vec_id")))
    best, begin, size = None, 0, 1
    while begin < shards:
        own = trees.filter(F.col("number").between(begin, begin + size - 1))
        run = max(1, -(-min(size, shards - begin) * blocks // at_once))
        tasks = own.groupBy("dim", F.expr(f"(number - {begin}) div {run}").alias("run")).agg(F.collect_list("path").alias("paths")).join(asked, "dim")
        if best is None:
            floors = F.lit(None).cast("array<struct<n:bigint,floor:bigint>>").alias("floors")
        else:
            kth = best.filter(f"rank = {k} AND score IS NOT NULL").groupBy("dim", "block").agg(F.collect_list(F.struct("n", F.col("score").alias("floor"))).alias("floors"))
            tasks, floors = tasks.join(kth, ["dim", "block"], "left"), F.col("floors")
        tasks = tasks.select("dim", "block", "queries", "paths", floors).repartition(-(-min(size, shards - begin) // run) * blocks, F.xxhash64("dim", "block", "paths"))
        found = tasks.mapInArrow(search, "dim int, block int, n long, vec_id long, score long, beyond boolean")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = stash(found.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
        begin, size = begin + size, size * GROWTH
    fits = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score does not fit a long"))).otherwise(F.col("score"))
    named = rows.filter("asks").select("n", F.col("vec_id").alias("query_id"))
    return best.join(named, "n").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
