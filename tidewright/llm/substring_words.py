"""Substring dedup over words: super-k-mer partitioning and exact counting by sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.superkmer import merged, repeated

WINDOW = 35
GRAM = 12
BATCH = 1 << 20


def sorted_counts(strings: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each packed string, which of its windows occur at least twice among all strings, by sorting windows."""
    split = [s.split(b" ") for s in strings]
    names: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in split])
    ids = np.fromiter((names.setdefault(w, len(names)) for x in split for w in x), np.int32, int(sizes.sum()))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(split)), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends, sizes, strict=True)]) if len(split) else np.zeros(0, np.int64)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, length)[first]).view(np.dtype((np.void, 4 * length))).reshape(-1)
    order = np.argsort(rows, kind="stable")
    line = rows[order]
    new = np.concatenate([[True], line[1:] != line[:-1]])
    group = np.cumsum(new) - 1
    times = np.bincount(group, weights=np.asarray(copies, float)[owner[order]])
    again = np.empty(len(rows), bool)
    again[order] = times[group] >= 2
    return np.split(again, np.cumsum(np.maximum(sizes - length + 1, 0))[:-1])


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove the words that repeated windows cover.

    docs: doc_id, text and any other columns (ignored). Returns doc_id, n_words, n_removed, kept_sha256 and, with
    ``with_text``, kept (the remaining words joined by a space). One row for each input row: a null text has no
    words; texts shorter than a window lose nothing; repeated rows repeat each other; null doc_ids stay null.
    """
    rows = repeated(docs, True, window, gram, lambda s, c: sorted_counts(s, c, window), BATCH)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = open_.decompress(z.as_py()).split()
                kept, at = [], 0
                for low, high in merged(found):
                    kept += words[at:low]
                    at = high
                kept += words[at:]
                text = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None))
            n, gone, sha, text = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(text, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return rows.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
