import random

import pytest

from test_substring import brute
from tidewright.llm.difference_cover import order, removed_bytes_by_order


@pytest.mark.parametrize("need", [3, 20])
def test_order_of_suffixes(spark, need):
    rng = random.Random(need)
    texts = ["".join(rng.choices("ab", k=rng.randrange(1, 25))) for _ in range(12)] + ["a" * 30, "a" * 30]
    rows = [(d, i, ord(c)) for d, t in enumerate(texts) for i, c in enumerate(t)]
    got = {(r.d, r.i): r.r for r in order(spark.createDataFrame(rows, "d long, i long, c long"), need).collect()}
    suffixes = {(d, i): texts[d][i:] for d, i, _ in rows}
    for a, s in suffixes.items():
        for b, t in suffixes.items():
            if s[:need] != t[:need]:
                assert (got[a] < got[b]) == (s < t) and got[a] != got[b]


def test_whole_order_matches_brute_force(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcde é", k=n))
    shared = letters(45)
    texts = [letters(rng.randrange(0, 60)) + rng.choice(["", shared, shared[3:40]]) + letters(rng.randrange(0, 40)) for _ in range(25)]
    texts += ["", None, "a", "ab" * 40, "x" * 70, texts[3], texts[4][:-2]]
    rows = [(i if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d int, i int").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_bytes_by_order(docs, 20).collect())
    want = brute(texts, 20, False)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want)) and sum(w[1] for w in want) > 0
