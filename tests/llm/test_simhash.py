import random

import numpy as np
import xxhash

from tidewright.llm import simhash
from tidewright.llm.components import components
from tidewright.llm.simhash import fingerprint, fuzzy_keys, golay_tables, near_duplicates, one_of_each


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    return [min((ids[j] for j in range(len(fps)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(fps))]


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉéZ", k=5)) for _ in range(200)]
    out = [None, "", "  \n", "One", "one", "two words", "a b c d"]
    for _ in range(12):
        words = rng.choices(vocabulary, k=200)
        out.append(" ".join(words))
        for n in (1, 2, 4):
            other = list(words)
            for p in rng.sample(range(200), n):
                other[p] = "edit"
            out.append(" ".join(other))
        out.append("\t".join(words).upper().replace("É", "É"))
    return out


def test_fingerprint_and_components(spark):
    all_ = texts()
    assert [fingerprint(t) for t in all_] == [plain(t) for t in all_]
    ids = [None if i % 11 == 5 else i for i in range(len(all_))]
    docs = spark.createDataFrame(list(zip(ids, all_, ids)), "doc_id long, text string, fp long").repartition(3)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_duplicates(docs).collect())
    want = classes(ids, [plain(t) for t in all_])
    assert got == sorted((str(i), f"{plain(t):016x}", str(c)) for i, t, c in zip(ids, all_, want))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want if c is not None})


def test_repeated_rows_and_nameless_groups(spark):
    docs = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "alone one two"), (None, "alone one two"), (2, "same text here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in one_of_each(docs).collect()) == [("1", "same text here"), ("None", "alone one two")]
    assert near_duplicates(docs.limit(0)).count() == one_of_each(docs.limit(0)).count() == 0


def test_keys_of_close_fingerprints_meet():
    rng, tables = np.random.default_rng(0), golay_tables()
    for _ in range(300):
        x = rng.integers(0, 2**63, dtype=np.uint64)
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        keys, rows = fuzzy_keys(np.array([x, x ^ np.uint64(flip)], np.uint64), tables)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(-50, 250), rng.randrange(-50, 250)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in label} == label


def test_one_id_with_several_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", 7), (1, "one two three four five six", 7), (2, "alpha beta gamma delta", 7), (None, "quite another text", 7)], "doc_id long, text string, did int")
    assert sorted(str(r.text) for r in one_of_each(docs).collect()) == ["alpha beta gamma delta", "one two three four five six", "quite another text"]
    assert one_of_each(docs).columns == docs.columns


def test_hot_buckets_are_parted(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(simhash, "HOT", 3)
    base = [f"w{rng.randrange(3000)}" for _ in range(250)]
    texts = []
    for _ in range(60):
        words = list(base)
        for p in rng.sample(range(250), rng.randrange(0, 4)):
            words[p] = f"x{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(base, k=200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(list(range(len(texts))), [plain(t) for t in texts])


def test_stage_keeps_one_of_texts_alike(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, n = [], 0
    for g in range(12):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 2):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(120)] = word()
            rows.append((n, " ".join(words), g))
            n += 1
    rows += [(None, "", -1), (None, None, -1), (n, "short one", -2), (n, "short one", -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(3)
    kept = simhash.one_of_each_alike(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.root) for r in kept.collect()) == sorted([*((str(4 * g), g) for g in range(12)), ("None", -1), (str(n), -2)])
    assert simhash.one_of_each_alike(docs.limit(0)).count() == 0
