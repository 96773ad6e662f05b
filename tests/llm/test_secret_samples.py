"""Held-out precision and recall of the Markov models, and what must not be flagged."""

import random
import string

import numpy as np
import pyarrow.parquet as pq

from tidewright.llm import secrets

ORDINARY = [
    "-" * 20, "=" * 24, "_" * 20, "+---+---+---+---+---+", "2024-01-01/2024-12-31_2025", "20240101-20241231-20250101", "v1-2-3-rc4-20240101-123456",
    "/usr/local/lib/python3/dist-packages/numpy", "getElementsByClassNameAndTagName", "MAX_CONNECTIONS_PER_HOST_DEFAULT", "-----BEGIN-RSA-PRIVATE-KEY-----",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789", "0" * 20 + "-" + "1" * 20, "/home/user/documents/report_final_version",
]
KEYS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_uppercase + string.digits]


def test_held_out_precision_and_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = secrets.train(docs)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    rng = random.Random(123)
    words = [m for t in texts for m in secrets.WORD.findall(t)]
    negative = [rng.choice("_/-").join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(2000)] + [secrets.drawn(50, seed)[50 + i][1] for seed in range(20) for i in range(50)]
    negative = [x for x in negative if len(x) >= 20 and not secrets.base_spans(x)]
    positive = ["".join(rng.choices(rng.choice(KEYS), k=rng.randrange(20, 64))) for _ in range(2000)]
    positive = [x for x in positive if not secrets.base_spans(x)]
    hits = sum(bool(secrets.spans_of(x, table, secrets.THRESHOLD)) for x in positive)
    false = sum(bool(secrets.spans_of(x, table, secrets.THRESHOLD)) for x in negative)
    assert hits / len(positive) > 0.99 and false / len(negative) < 0.002 and len(negative) > 2000
    assert [x for x in ORDINARY if secrets.spans_of(x, table, secrets.THRESHOLD)] == []


def test_unlabelled_secrets_are_found_in_prose(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    draw = lambda: "".join(rng.choices(KEYS[0], k=40))
    rows = [(i, f"{r.text or ''} {key} end", key) for i, r in enumerate(docs.collect()) for key in [draw()]]
    planted = spark.createDataFrame(rows, "doc_id long, text string, found string")
    kept = {r.doc_id: [x.secret for x in r.found if x.kind == "markov"] for r in secrets.scan(planted).collect()}
    assert np.mean([kept[i] == [key] for i, _, key in rows]) > 0.99


def test_repeated_rows_and_no_rows(spark):
    key = "Zx9" * 2 + "qWp7LmR4tYv2KdB8nHc6"
    docs = spark.createDataFrame([(None, f"use {key} now"), (None, f"use {key} now"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), [x.secret for x in r.found]) for r in secrets.scan(docs).collect())
    assert got == [("3", []), ("None", [key]), ("None", [key])]
    assert np.isfinite(secrets.train(docs.limit(0))).all()
