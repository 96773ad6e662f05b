"""Mixing sources to target weights by a Pfair schedule, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stash, text_key

BLOCK = 64
#: Blocks of each class in a period of the schedule; all sources not named are one class.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}
OTHER, OTHER_WEIGHT = "(other)", 16
#: The schedule of one period has as many rows as the weights' sum; it is the only thing that may be broadcast.
MOST_SLOTS = 100_000
CHUNK = 4096


def schedule(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """``class, weight, nth, slot`` for one period: which slot the class's nth block (from 0) takes.

    Class i with weight a of A blocks has for its jth block (from 1) release floor((j - 1) A / a) and deadline
    ceil(j A / a). Each slot goes to the released block of earliest deadline, ties in class order. On one processor
    that meets all deadlines, so after t slots a class is less than one block from t a / A; the period repeats.
    """
    if not weights or any(int(a) != a or a < 1 for a in weights.values()) or (total := sum(weights.values())) > MOST_SLOTS:
        raise ValueError(f"weights must be positive whole numbers that sum to {MOST_SLOTS} at most")
    rows = [F.struct(F.lit(c).alias("class"), F.lit(int(a)).cast("long").alias("weight")) for c, a in sorted(weights.items())]
    classes = spark.range(1).select(F.inline(F.array(*rows)))
    every = classes.agg(F.sort_array(F.collect_list(F.struct("class", "weight"))).alias("w")).coalesce(1)
    due = f"""array_min(transform(w, (x, i) -> CASE WHEN (s.done[i] * {total}L) div x.weight <= t
        THEN struct(((s.done[i] + 1) * {total}L + x.weight - 1) div x.weight AS due, cast(i AS long) AS i)
        ELSE struct({2**62}L AS due, cast(i AS long) AS i) END)).i"""
    fold = f"""aggregate(sequence(0L, {total - 1}L),
        named_struct('done', transform(w, x -> 0L), 'picks', cast(array() AS array<bigint>), 'pick', -1L),
        (s, t) -> transform(array({due}), p -> named_struct('done', transform(s.done, (d, i) -> d + if(i = p, 1L, 0L)), 'picks', array_append(s.picks, p), 'pick', p))[0],
        s -> s.picks)"""
    picked = every.select("w", F.posexplode(F.expr(fold)).alias("slot", "i")).select(F.col("slot").cast("long").alias("slot"), F.expr("w[cast(i AS int)]").alias("x"))
    nth = F.row_number().over(Window.partitionBy("x.class").orderBy("slot")) - 1
    return picked.select("x.class", "x.weight", nth.cast("long").alias("nth"), "slot")


ADDED = ("_class", "_block", "_slot", "_position")


def placed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER_WEIGHT, block: int = BLOCK) -> DataFrame:
    """``row`` (a struct of all columns of docs, whose names so can't clash) with ``class, block, slot, position``.

    docs: doc_id, text, source and any other columns. A source's rows in order of doc_id (nulls first, ties by 128 bits of the text,
    then by a hash of all columns but maps: rows that agree in all of it are interchangeable) form blocks of ``block`` rows. Sources
    that are not named, null ones included, are one class of weight ``other``. No row is dropped: once a class has no
    blocks left its slots are passed over, and the others keep their ratios. Rows of one class, however many, are spread
    over range partitions; running counts are kept for each partition and class only. An empty table gives none.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.col("source").cast("string"), F.lit(OTHER))
    label = F.when(named.isin([c for c in weights if c != OTHER]), named).otherwise(OTHER)
    plan = stash(schedule(spark, {**{c: a for c, a in weights.items() if c != OTHER}, OTHER: other}), "schedule")
    one, two = text_key(F.col("text"))
    rest = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), label.alias("class"), F.col("doc_id").alias("id"), one.alias("one"), two.alias("two"), rest.alias("rest"))
    order = ["class", F.col("id").asc_nulls_first(), "one", "two", "rest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "class", F.monotonically_increasing_id().alias("at"))
    rows = stash(rows, "ranged").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("class", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part")
    parts = stash(parts.withColumns({"base": F.sum("n").over(before) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("class"))}).drop("n"), "parts")
    weight = plan.groupBy("class").agg(F.first("weight").alias("weight"))
    parts = parts.join(F.broadcast(weight), "class")
    rows = rows.join(parts, ["class", "part"]).withColumn("rank", F.expr("at - from + base")).withColumn("block", F.expr(f"rank div {block}"))
    plan = F.broadcast(plan.select("class", "nth", F.col("slot").alias("in_period")))
    period = sum(a for c, a in weights.items() if c != OTHER) + other
    rows = rows.withColumn("nth", F.expr("block % weight")).join(plan, ["class", "nth"]).withColumn("slot", F.expr(f"(block div weight) * {period} + in_period"))
    heads = rows.filter(f"rank % {block} = 0").select("slot", F.expr(f"least({block}, total - rank)").alias("size"), F.expr(f"slot div {CHUNK}").alias("chunk"))
    chunks = heads.groupBy("chunk").agg(F.sum("size").alias("size"))
    chunks = chunks.select("chunk", (F.sum("size").over(Window.orderBy("chunk")) - F.col("size")).alias("ahead"))
    inner = F.sum("size").over(Window.partitionBy("chunk").orderBy("slot")) - F.col("size")
    starts = heads.withColumn("inner", inner).join(chunks, "chunk").select("slot", (F.col("inner") + F.col("ahead")).alias("start"))
    rows = rows.join(stash(starts, "starts"), "slot").withColumn("position", F.expr(f"start + rank % {block}"))
    return rows.select("row", "class", "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER_WEIGHT, block: int = BLOCK) -> DataFrame:
    """docs with ``_class, _block, _slot, _position`` added (``placed``): the order in which blocks of sources interleave.

    A column of docs that has one of these four names gives way to the added one; ``in_order`` keeps all columns.
    """
    found = placed(docs, weights, other, block)
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *(F.col(c[1:]).alias(c) for c in ADDED))


def in_order(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER_WEIGHT, block: int = BLOCK) -> DataFrame:
    """docs, all rows and the same columns, sorted by their place in the mix."""
    return placed(docs, weights, other, block).repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keys = docs.select("doc_id", F.concat_ws(" ", *text_key(F.col("text"))).alias("text"), "source")  # the text decides ties only
    return mixed(keys).select("doc_id", "source", F.col("_class").alias("class"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def oracle() -> str:
    """The same schedule and positions in DuckDB, for tables whose doc_ids are unique."""
    pairs = sorted({**WEIGHTS, OTHER: OTHER_WEIGHT}.items())
    total = sum(a for _, a in pairs)
    names, a = ", ".join(f"'{c}'" for c, _ in pairs), ", ".join(str(a) for _, a in pairs)
    named = ", ".join(f"'{c}'" for c in WEIGHTS)
    return f"""
WITH RECURSIVE w AS (SELECT [{names}] AS names, CAST([{a}] AS BIGINT[]) AS a),
s AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, a, names FROM w
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, a, names FROM (
    SELECT t, done, a, names, list_min(list_transform(a, lambda x, i: CASE WHEN (done[i] * {total}) // x <= t + 1
        THEN ((done[i] + 1) * {total} + x - 1) // x * 1000 + i ELSE 1000000000000 + i END)) % 1000 AS p
    FROM s WHERE t < {total - 1})),
plan AS (SELECT names[pick] AS class, a[pick] AS weight, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth, t AS slot FROM s WHERE t >= 0),
ranked AS (SELECT doc_id, source, class, row_number() OVER (PARTITION BY class ORDER BY doc_id) - 1 AS rank FROM (
    SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS class FROM documents)),
placed AS (SELECT r.*, rank // {BLOCK} AS block, (rank // {BLOCK} // p.weight) * {total} + p.slot AS slot
    FROM ranked r JOIN plan p ON r.class = p.class AND (r.rank // {BLOCK}) % p.weight = p.nth)
SELECT doc_id, source, class, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, rank) - 1 AS BIGINT) AS position FROM placed
"""
