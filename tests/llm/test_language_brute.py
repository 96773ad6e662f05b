"""Language identification against plain Python, on held-out rows, and on odd tables."""

import math
import random
import re

import pytest

from tidewright.llm import language

WORDS = {"en": "the and with from that house river stone of".split(), "de": "der und mit von dass haus fluss stein ist".split(), "fr": "le et avec de que maison rivière pierre est".split()}


def bins(text):
    low = [32] + [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 if 48 <= b <= 57 else 32 for b in (text or "").encode()] + [32]
    return [((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 17 for a, b, c in zip(low, low[1:], low[2:]) if b != 32 and 0 not in (a, b, c)]


def parent(host):
    return ".".join(host.split(".")[-2:]) if "." in host else re.sub("[0-9]+$", "", host)


def plain(rows, model):
    """rows: (id, text, declared, suffix, host); the posterior by its definition, row by row."""
    names, k = model.languages, len(model.languages)
    known = lambda x: x if x in names else "" if not x else "?"
    rows = [(i, bins(t), known(d), known(s), h or "") for i, t, d, s, h in rows]
    logs = [[sum(float(model.table[b, c]) for b in t) for c in range(k + 1)] for _, t, *_ in rows]
    best = [max(range(k + 1), key=lambda c: (x[c], -c)) if r[1] else k for x, r in zip(logs, rows)]
    count = lambda keep: [sum(b == c and keep(r) for b, r in zip(best, rows)) for c in range(k)]
    shares = [n + 1 for n in count(lambda r: True)]
    shares = [n / sum(shares) for n in shares]
    smooth = lambda own, up: [(n + language.STRENGTH * u) / (sum(own) + language.STRENGTH) for n, u in zip(own, up)]
    prior = {h: smooth(count(lambda r, h=h: r[4] == h), smooth(count(lambda r, h=h: parent(r[4]) == parent(h)), shares)) for h in {r[4] for r in rows}}

    def confusion(column):
        values = ["", "?", *names]
        grid = {v: [n + language.PSEUDO / len(values) + (language.PSEUDO if v == names[c] else 0) for c, n in enumerate(count(lambda r, v=v: r[column] == v))] for v in values}
        return {v: [math.log(grid[v][c] / sum(grid[u][c] for u in values)) for c in range(k)] for v in values}

    declared, suffix = confusion(2), confusion(3)
    out = []
    for r, x in zip(rows, logs):
        d, s = declared[r[2]], suffix[r[3]]
        score = {names[c]: x[c] * language.TEMPER + math.log(prior[r[4]][c]) + d[c] + s[c] for c in range(k)}
        silent = not r[1] and r[2] in ("", "?") and r[3] in ("", "?")
        score["und"] = 1e9 if silent else x[k] * language.TEMPER + math.log(min(shares)) - language.DOUBT + min(d) + min(s)
        top = max(score, key=lambda n: (score[n], n))
        out.append((str(r[0]), top, round(1 / sum(math.exp(v - score[top]) for v in score.values()), 6), top == "und"))
    return sorted(out)


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 25)))
        if i % 9 == 0:
            text = f'<html lang="{lang}">{text}'
        if i % 11 == 0:
            text += f" see https://www.site.{rng.choice(['de', 'fr', 'io'])}/x"
        rows.append((i if i % 13 else None, text, lang if i % 4 else None, rng.choice(["a.example.org", "b.example.org", "src1", "src2", None])))
    rows += [(900, None, None, "src1"), (901, "", "en", None), (902, "123 456 %%", None, "src2"), (903, "0x1 0x2 " * 60, None, None), (904, "the", "de", "src1"), *[(7, rows[7][1], "en", "src9")] * 3]
    return rows


def test_documents_match_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    model = language.train(docs)
    evidence = language.evidence_of_documents(docs)
    got = sorted((str(r.id), r.language, round(r.confidence, 6), r.rejected) for r in language.identify(evidence, model).collect())
    want = plain([(r.id, r.text, r.declared, r.suffix, r.host) for r in evidence.collect()], model)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5)
    gone = {g[0] for g in got if g[3]}
    assert gone == {"900", "901", "902", "903"}
    assert sorted(str(r.doc_id) for r in language.known_language(docs).collect()) == sorted(g[0] for g in got if not g[3])


def test_pages_match_plain_python(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    rng = random.Random(4)
    pages = [(i, f"http://h{i % 4}.{rng.choice(['de', 'fr', 'com'])}/{rng.choice(['fr/', 'x', 'de/'])}p", f"<html{rng.choice(['', ' lang=fr', ' lang=xx'])}><style>der und mit</style><p>{' '.join(rng.choices(WORDS[rng.choice(list(WORDS))], k=12))}</p>") for i in range(80)] + [(None, None, None), (99, "", "<p></p>")]
    evidence = language.evidence_of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = sorted((str(r.id), r.language, r.rejected) for r in language.identify(evidence, model).collect())
    assert got == [(a, b, d) for a, b, _, d in plain([(r.id, r.text, r.declared, r.suffix, r.host) for r in evidence.collect()], model)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    model = language.train(docs.filter("doc_id % 2 = 0"))
    found = language.identify(language.evidence_of_documents(docs.filter("doc_id % 2 = 1")), model)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    judged = [(truth[r.id], r.language) for r in found.collect() if not r.rejected]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the house and the river", "en", "x", 5, 6), (2, None, None, None, 5, 6)], "doc_id long, text string, lang string, source string, _id int, tag int")
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and [tuple(r)[0] for r in kept.collect()] == [1]
