"""Helpers shared by the corpus operators: shared scratch tables, row identity, Arrow text access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# scratch tables are used through this module
from tidewright.sources.scratch import drop, drop_since, fresh_path, qualified, scratch_mark, shared_dir, small_batches, stash  # noqa: F401

#: ASCII white space: the bytes between words, as in ``[^\x20\x09-\x0D]+`` and ``bytes.split()``.
SPACES = b"\t\n\x0b\x0c\r "
NO_ID = -(2**63)


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text (null: empty): two XXH64 hashes, of unlike seeds."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit("tidewright"), whole)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``did, one, two, doc_id, text``: doc_id and 128 bits of the text identify a row; null ids are ``NO_ID`` in did.

    Rows that agree in doc_id and text are one and the same to every operator: their results are equal.
    """
    one, two = text_key(F.col("text"))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("did"), one.alias("one"), two.alias("two"), doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that ``gone`` (did, one, two) identifies; columns stay as they are, whatever their names.

    The rows' own columns travel as one struct, so that no name of theirs can clash.
    """
    return _split(docs, gone, "left_anti")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that ``kept`` (did, one, two) identifies."""
    return _split(docs, kept, "left_semi")


def wrapped(docs: DataFrame) -> DataFrame:
    """``row, did, one, two``: each row as one struct with its identity."""
    one, two = text_key(F.col("text"))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), one.alias("one"), two.alias("two"))


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def _split(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    return unwrapped(wrapped(docs).join(marked.select("did", "one", "two"), ["did", "one", "two"], how))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and their int64 offsets (null: empty)."""
    if column.type not in (pa.large_binary(), pa.binary()):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unsigned_hex(col: Column) -> Column:
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
