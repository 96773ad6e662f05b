"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import ast
import builtins
import datetime
import decimal
import email.message
import errno
import http.client
import inspect
import json
import locale
import logging
import os
import random
import re
import signal
import socket
import ssl
import string
import subprocess
import sys
import threading
import typing
import unittest
import urllib.request
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from xml.dom import minidom

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns, the least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge, and the shortest.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
START = len(ALPHABET)
#: Between the parts of a candidate; the least length of what is judged.
SEPARATORS, LEAST = "+/_=-", 20
#: Log-likelihood ratio from which a string is a secret; weights, in transitions, of a character's own frequency in each
#: row of the transition matrices, and in that of the frequency over both kinds of samples.
THRESHOLD = 20.0
BACKOFF = 5.0
POOLED = 20.0
#: Labelled samples of each kind that are drawn besides the corpus's own.
DRAWN = 2000
_CODE = np.full(128, -1)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str, tuple[int, int]]]:
    """(start, end, kind, value range) of the fixed patterns, by start and kind."""
    out = [(m.start(), m.end(), 0, m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1, m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2, m.span()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(out, key=lambda x: (x[0], x[2]))]


def codes_of(string: str) -> np.ndarray:
    return _CODE[np.frombuffer(string.encode("ascii"), np.uint8)]


def ratio(string: str, table: np.ndarray) -> float:
    """Log-likelihood ratio of a candidate under the two models; table: by (previous, next) character."""
    codes = codes_of(string)
    return float(table[np.concatenate([[START], codes[:-1]]), codes].sum())


def parts_of(string: str, table: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Ranges of a candidate that the models call random, by start: all of it, or else the best runs of its parts.

    A run of parts lies between separators and has ``LEAST`` characters or more. The run of the highest ratio is taken if that
    reaches the threshold, with padding that ends the candidate, and what lies before and after it is searched again.
    """
    if ratio(string, table) >= threshold:
        return [(0, len(string))]
    codes = codes_of(string)
    apart = np.isin(codes, [ALPHABET.index(c) for c in SEPARATORS])
    edge = np.diff(np.concatenate([[0], (~apart).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[0.0, 0.0], np.cumsum(table[codes[:-1], codes[1:]])])  # of steps to the characters from the second on
    gain = table[START, codes[starts]] - sums[starts + 1]
    out, open_ = [], [(0, len(starts))]
    while open_:
        low, high = open_.pop()
        if low >= high:
            continue
        best, at = np.maximum.accumulate(gain[low:high]), np.searchsorted(starts[low:high], ends[low:high] - LEAST, "right") - 1
        score = np.where(at >= 0, sums[ends[low:high]] + best[at], -np.inf)
        end = int(score.argmax())
        if score[end] < threshold:
            continue
        begin = int(gain[low : low + at[end] + 1].argmax())
        last = int(ends[low + end])
        out.append((int(starts[low + begin]), len(string) if string[last:] in ("=", "==") else last))
        open_ += [(low, low + begin), (low + end + 1, high)]
    return sorted(out)


def labelled(texts: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Labelled samples of texts: values that a fixed pattern names are random (1), other words and strings ordinary (0)."""
    for text in texts:
        spans = base_spans(text)
        yield from ((1, text[a:b]) for _, _, _, (a, b) in spans)
        at = 0
        for a, b, *_ in [*spans, (len(text), len(text), "", (0, 0))]:
            if a > at:
                yield from ((0, w) for w in WORD.findall(text, at, a))
            at = max(at, b)


WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")


def known_names() -> list[str]:
    """Identifiers of programs: those of Python's standard library, in snake, camel and upper case."""
    modules = (ast, builtins, datetime, decimal, email.message, errno, http.client, inspect, json, locale, logging, minidom, os, signal, socket, ssl, string, subprocess, threading, typing, unittest, urllib.request)
    found = {name for module in modules for name in dir(module)} | {name for module in modules for own in vars(module).values() if isinstance(own, type) for name in dir(own)} | set(sys.stdlib_module_names)
    names = sorted(name.strip("_") for name in found if name.isascii() and len(name) > 2)
    return sorted(set(names) | {"".join(part.capitalize() for part in name.split("_")) for name in names} | {name.upper() for name in names})


def drawn(n: int = DRAWN, seed: int = 11) -> list[tuple[int, str]]:
    """Labelled samples that a corpus may lack: random strings of common key alphabets (1); names of programs and paths of them,
    dates, numbers, versions, ranges and rules (0), which are no secrets though no prose either. The same for every corpus."""
    rng, out = random.Random(seed), []
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + "234567", string.ascii_uppercase + string.digits, "0123456789abcdef"]
    for i in range(n):
        out.append((1, "".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(20, 65)))))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    date = lambda: f"{rng.randrange(1900, 2100)}{(sign := rng.choice('-/_.'))}{rng.randrange(1, 13):02d}{sign}{rng.randrange(1, 32):02d}"
    kinds = [
        lambda: rng.choice("-=_+/.") * rng.randrange(8, 80),
        lambda: "".join(rng.choices(["-", "=", "+", "--", "==", "-+", "=-", "/-"], k=rng.randrange(8, 40))),
        lambda: rng.choice(["/", "_", "-", "="]).join(date() for _ in range(rng.randrange(1, 4))),
        lambda: f"{date()}_{digits(rng.choice([2, 4, 6]))}",
        lambda: digits(rng.randrange(8, 40)),
        lambda: (string.ascii_uppercase * 2)[(at := rng.randrange(26)) : at + rng.randrange(8, 27)] + string.digits[: rng.choice([0, 10])],
        lambda: (string.ascii_lowercase * 2)[(at := rng.randrange(26)) : at + rng.randrange(8, 27)] + string.digits[: rng.choice([0, 10])],
        lambda: rng.choice("-./_").join(digits(rng.randrange(1, 5)) for _ in range(rng.randrange(3, 9))),
        lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=1)) * rng.randrange(8, 50),
    ]
    out += [(0, kinds[i % len(kinds)]()) for i in range(n)]
    names = known_names()
    out += [(0, rng.choice("/_-+=").join(rng.choices(names, k=rng.randrange(1, 6)))) for _ in range(4 * n)]
    out += [(0, "".join(rng.choices(names, k=2))) for _ in range(n)]
    return out + [(0, word) for word in names]


def counted(words: tuple[list[str], list[str]]) -> np.ndarray:
    """Transitions (previous, next) of ordinary and of random strings, flat, by kind."""
    size = len(ALPHABET) + 1
    total = np.zeros((2, size * size), np.int64)
    for label in (0, 1):
        joined = np.frombuffer("\n".join(["", *words[label]]).encode("ascii"), np.uint8)
        codes = np.where(joined == 10, START, _CODE[joined])
        before, after = codes[:-1], codes[1:]
        keep = after != START
        total[label] += np.bincount(before[keep] * size + after[keep], minlength=size * size)
    return total


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """The table of log-ratios from transition counts (kind, previous, next).

    A row backs off to its model's character frequencies, and those to the frequencies that both models share, so a
    character that neither has seen speaks for neither.
    """
    single = counts.sum(axis=1, keepdims=True)
    pooled = single.sum(axis=0, keepdims=True) + 1.0
    single = (single + POOLED * pooled / pooled.sum()) / (single.sum(axis=2, keepdims=True) + POOLED)
    model = np.log((counts + BACKOFF * single) / (counts.sum(axis=2, keepdims=True) + BACKOFF))
    return model[1] - model[0]


def train(docs: DataFrame) -> np.ndarray:
    """The table of log-ratios, from transition counts over all texts (two matrices of fixed size reach the driver) and ``drawn`` samples.

    docs: text; null texts are empty, and an empty table leaves the drawn samples alone.
    """
    size = len(ALPHABET) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * size), np.int64)
        for batch in batches:
            words: tuple[list[str], list[str]] = ([], [])
            for label, word in labelled(t.as_py() or "" for t in batch.column(0)):
                words[label].append(word)
            total += counted(words)
        label, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[label, cell])], ["label", "cell", "n"])

    samples = drawn()
    counts = counted(([w for label, w in samples if not label], [w for label, w in samples if label])).astype(float)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.cell] += r.n
    return log_ratios(counts.reshape(2, size, size)[:, :, :START])


def spans_of(text: str, table: np.ndarray, threshold: float) -> list[tuple[int, int, str]]:
    """All spans of a text by start and kind: the fixed ones, and what the models call random of the candidates clear of them."""
    base = [(a, b, k) for a, b, k, _ in base_spans(text)]
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    added = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if not (before and reach[before - 1] > a):
            added += [(a + x, a + y, "markov") for x, y in parts_of(m.group(), table, threshold)]
    return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, table: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, found`` (array of kind, start, end, secret) for each row of docs (doc_id, text; others are ignored).

    Places are code points, end exclusive. A null text is empty; nothing found gives an empty array. table: from
    ``train`` (by default trained on docs).
    """
    table = train(docs) if table is None else table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        for batch in batches:
            found = []
            for t in batch.column(1):
                text = t.as_py() or ""
                found.append([{"kind": k, "start": a, "end": b, "secret": text[a:b]} for a, b, k in spans_of(text, table, threshold)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,secret:string>>")


def digest(found: DataFrame) -> DataFrame:
    """``scan``'s rows as counts, the base spans' SHA-256 and all spans in one string."""
    say = "transform({}, x -> concat_ws(':', x.kind, x.start, x.end))"
    base = "filter(found, x -> x.kind != 'markov')"
    count = lambda k: F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) AS long)")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.expr(f"array_join({say.format(base)}, ',')").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join({say.format('found')}, ',')").alias("spans"),
        count("markov").alias("n_markov"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
