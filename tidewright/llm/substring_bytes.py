"""Substring dedup over bytes: difference-cover suffix arrays over minimiser buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.suffix import equal_prefix, suffix_array
from tidewright.llm.superkmer import merged, repeated

LENGTH = 200
GRAM = 64
BATCH = 1 << 19
#: Bytes of distinct strings above which a minimiser's strings are cut into pieces.
LIMIT = 1 << 20


def adjacent_equal(strings: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each string, which of its ``length``-byte substrings start anywhere else among all strings.

    The strings, with a separator after each, get one suffix array; two equal substrings have neighbours with the
    same prefix, so comparing adjacent suffixes finds every substring that occurs twice.
    """
    data = np.frombuffer(b"".join(s + b"\0" * 8 for s in strings) + b"\0" * 8, np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes + 8) - sizes - 8
    codes = data.astype(np.int64) + 2
    for b, n in zip(begins, sizes, strict=True):
        codes[b + n : b + n + 8] = 1
    codes = codes[: begins[-1] + sizes[-1] + 8]
    counts = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(codes), bool)
    for b, n in zip(begins, counts, strict=True):
        valid[b : b + n] = True
    order = suffix_array(codes, 257)
    order = order[valid[order]]
    same = equal_prefix(data, order[:-1], order[1:], length)
    again = np.zeros(len(codes), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [np.ones(n, bool) if c > 1 else again[b : b + n] for b, n, c in zip(begins, counts, copies, strict=True)]


def removed_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """Remove the bytes that repeated ``length``-byte substrings cover; documents are never joined.

    docs: doc_id, text and any other columns (ignored). Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, with ``with_bytes``, kept (binary). One row for each input row: a null text is empty; texts shorter than
    ``length`` lose nothing; repeated rows repeat each other; null doc_ids stay null.
    """
    return finished(repeated(docs, False, length, gram, lambda s, c: adjacent_equal(s, c, length), BATCH, LIMIT), with_bytes)


def finished(rows: DataFrame, with_bytes: bool = False) -> DataFrame:
    """The results of rows (doc_id, z, spans): texts less the bytes that their spans cover."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = open_.decompress(z.as_py())
                ranges = merged(found)
                at, kept = 0, []
                for low, high in ranges:
                    kept.append(text[at:low])
                    at = high
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            n, gone, count, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
