import random

import pyarrow as pa
import pytest

from tidewright.llm import jaccard, simhash


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= 0.8


def corpus(seed=2, groups=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(groups):
        first = [word() for _ in range(rng.choice([40, 120, 300]))]
        out.append(" ".join(first))
        for edits in [0, 1, 1, 3, 5, 9]:
            copy = list(first)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if edits == 3 else "  ".join(copy))
    out += ["", None, " ", "one two", "One  two", "one three"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("deal", [500, 3])
def test_no_two_texts_that_stay_are_alike(spark, deal):
    texts = corpus()
    rows = [(i if i % 11 else None, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = jaccard.one_of_each(docs, deal=deal)
    assert out.columns == docs.columns
    kept = [r.text for r in out.collect()]
    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])
    if deal == 500:
        assert all(any(alike(t, k) for k in kept) for t in texts)
        assert len(kept) > 25


def test_smallest_id_stays(spark):
    base = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in (5, 9, 2, None)], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.one_of_each(docs).collect()] == [2]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_texts_of_the_stage_travel_in_small_batches(spark, monkeypatch):
    """By count alone 4,000 texts of 4 kB are one batch of 16 MB."""
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('ab c', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def most():
        return max(r.n for r in docs.mapInArrow(sizes, "n long").collect())

    seen = []
    monkeypatch.setattr(simhash, "linked", lambda d, shingle: seen.append(most()) or (d.selectExpr("1 AS did", "1 AS one", "1 AS two", "1 AS fp"), d, d))
    monkeypatch.setattr(jaccard, "one_of_each", lambda d, similarity, groups, joined: seen.append(most()))
    simhash.one_of_each_alike(docs)
    assert max(seen) < 3 << 20
    assert most() > 10 << 20  # outside, batches are as the session has them
