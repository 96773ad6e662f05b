import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import chat, decontaminate, language, mixing, secrets, sstable, topk
from tidewright.llm.common import fresh_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_secret_base(spark):
    texts = [None, "", "Password = 'abc123456' x", "API_KEY:abcdef token: abc", "AKIA" + "A1" * 8 + " AKIAAB", "deadbeef" * 4, "secret=token: abcdef", "é" * 5 + 'apikey":"' + "f" * 30, "ſecret=abcdefgh", "passwd==abcde"]
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

    def plain(t):
        t = t or ""
        out = [(m.start(), 0, m.end()) for m in re.finditer("(?ai)" + assign, t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))
        return (*(sum(k == x for _, k, _ in out) for x in range(3)), hashlib.sha256(said.encode()).hexdigest(), said)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = np.zeros((len(secrets.ALPHABET) + 1, len(secrets.ALPHABET)))
    got = [tuple(r)[1:6] for r in secrets.digest(secrets.scan(docs, table)).orderBy("doc_id").collect()]
    assert got == [plain(t) for t in texts]
    assert secrets.digest(secrets.scan(docs.limit(0))).count() == 0


def test_added_spans_keep_clear_of_base_ones():
    rng = random.Random(4)
    table = np.ones((len(secrets.ALPHABET) + 1, len(secrets.ALPHABET)))
    for _ in range(200):
        text = "".join(rng.choice([" ", "token=", "a" * 24, "AKIA" + "B" * 20, "Zq" * 12, "secret: "]) for _ in range(30))
        base = [(a, b) for a, b, _, _ in secrets.base_spans(text)]
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if not any(x < m.end() and m.start() < y for x, y in base)]
        assert [(a, b) for a, b, k in secrets.spans_of(text, table, 20.0) if k == "markov"] == want


def test_secret_models_tell_random_from_ordinary(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda: "".join(rng.choices(letters, k=32))
    syllables = ["read", "write", "file", "name", "list", "user", "count", "index", "value", "table", "merge", "split"]
    name = lambda: "_".join(rng.choices(syllables, k=6))
    train = [f"token={draw()} and {name()} then {name()}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    table = secrets.train(docs)
    held = [draw() for _ in range(200)], [name() for _ in range(200)]
    assert np.mean([secrets.ratio(s, table) >= secrets.THRESHOLD for s in held[0]]) > 0.97
    assert np.mean([secrets.ratio(s, table) >= secrets.THRESHOLD for s in held[1]]) < 0.02
    one = spark.createDataFrame([(1, f"see {held[0][0]} or {held[1][0]}")], "doc_id long, text string")
    assert [s.kind for s in secrets.scan(one, table).first().found] == ["markov"]


def test_secret_behind_a_name_is_found(spark):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda: "".join(rng.choices(letters, k=32))
    syllables = ["database", "connection", "string", "read", "write", "file", "name", "list", "user", "count", "index", "value"]
    name = lambda: "_".join(rng.choices(syllables, k=6))
    table = secrets.train(spark.createDataFrame([(i, f"token={draw()} and {name()} then {name()}") for i in range(400)], "doc_id long, text string"))
    for glue in ("{0}={1}", "{0}_{1}", "{0}/{1}/{0}", "{0}={1}==", "{1}-{0}"):
        hits = 0
        for _ in range(100):
            key, value = name(), draw()
            text = glue.format(key, value)
            found = [text[a:b] for a, b, _ in secrets.spans_of(text, table, secrets.THRESHOLD)]
            hits += len(found) == 1 and value in found[0]
        assert hits >= 95, (glue, hits)
    key, one, two = "_".join(syllables * 2), draw(), draw()
    text = f"{key}={one}/{key}={two}/{key}"
    assert [text[a:b] for a, b, _ in secrets.spans_of(text, table, secrets.THRESHOLD)] == [one, two]
    assert np.mean([len(secrets.spans_of(f"{name()}={name()}/{name()}", table, secrets.THRESHOLD)) for _ in range(300)]) < 0.02


def test_best_runs_match_brute_force():
    rng = random.Random(3)
    for seed in range(200):
        table = np.random.default_rng(seed).normal(-0.2, 1, (len(secrets.ALPHABET) + 1, len(secrets.ALPHABET)))
        text = "".join(rng.choice("aB3_/=") for _ in range(rng.randrange(20, 90)))
        apart = lambda i: not 0 <= i < len(text) or text[i] in secrets.SEPARATORS
        runs = [(a, b) for a in range(len(text)) for b in range(a + 20, len(text) + 1) if apart(a - 1) and not apart(a) and apart(b) and not apart(b - 1)]
        best = max((secrets.ratio(text[a:b], table) for a, b in runs), default=-1e9)
        got = secrets.parts_of(text, table, 8.0)
        if secrets.ratio(text, table) >= 8.0:
            assert got == [(0, len(text))]
        elif abs(best - 8.0) > 1e-6:
            assert bool(got) == (best >= 8.0)
            scores = [secrets.ratio(text[a:b], table) for a, b in ((a, b - len(text[a:b]) + len(text[a:b].rstrip("="))) for a, b in got)]
            assert not got or abs(max(scores) - best) < 1e-6 and min(scores) >= 8.0 - 1e-6


def test_chat(spark):
    says = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 1, "assistant", "a\\n<|x"), (1, 0, "user", says), (2, 0, "assistant", None), (2, 1, None, "\\"), (None, 0, "as\nsistant", "z"), (3, 0, "assistant", "é" * 9), (3, 1, "assistant", says), (3, 1, "assistant", says)]
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and not r.rewrites
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_finds_templates_that_rewrite_history():
    numbered = lambda turns: f"{len(turns)} turns\n" + chat.chatml(turns)
    assert chat.spans([("user", "x"), ("assistant", "y")], numbered)[2]
    text, spans, rewrites = chat.spans([("user", "<|"), ("assistant", "a"), ("user", "")], chat.chatml)
    assert not rewrites and [s["end"] for s in spans] == [s["start"] for s in spans[1:]] + [len(text)]
    assert text[spans[1]["text_start"] : spans[1]["text_end"]] == "a"


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6) * 2, 1)]) for i in range(900)]
    rows += [(100, rows[100][1]), (100, rows[3][1]), (None, rows[7][1]), (901, None), (902, [1.0, None]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (1000, [1.0, 2.0]), (1001, []), (1100, [])]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    got = sorted(map(tuple, topk.top_k(df, "vec_id % 100 = 0", 10, 128).collect()), key=str)
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(usable):
        if i is not None and i % 100 == 0:
            scores = sorted((-int(v @ w), -(2**63) if j is None else j) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v))[:10]
            want += [(i, r + 1, None if j == -(2**63) else j, -s) for r, (s, j) in enumerate(scores)]
    assert got == sorted(want, key=str)
    assert topk.top_k(df.limit(0), "vec_id % 100 = 0").count() == 0


def edit_distance(a, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(8)
    syllables = ["ti", "on", "er", "the", "an", "re", "ou", "é"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    items = [prose(rng.randint(8, 40)) for _ in range(12)] + ["", None, "ab"]
    docs = [prose(60) for _ in range(25)] + [None, ""]
    for _ in range(60):
        item = list(rng.choice(items[:12]))
        for _ in range(rng.randint(0, 14)):
            p = rng.randrange(len(item))
            item[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "q7"])
        docs.append(prose(rng.randint(0, 30)) + rng.choice([" ", "!! "]) + "".join(item).upper() + " " + prose(rng.randint(0, 30)))
    found = decontaminate.leaks(spark.createDataFrame([(i, d, 0) for i, d in enumerate(docs)], "doc_id long, text string, item_id int"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    best = {}
    for r in found:
        best[r.doc_id, r.item_id] = min(best.get((r.doc_id, r.item_id), 99), r.edits)
        assert r.edits <= decontaminate.BUDGET * r.item_chars
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            a = decontaminate.normal(t)
            if len(a) >= decontaminate.Q:
                e = edit_distance(a, decontaminate.normal(d))
                if e <= min(int(len(a) * decontaminate.BUDGET), (len(a) - decontaminate.Q) // decontaminate.Q):
                    want[i, j] = e
    assert best == want and len(want) > 20
    few = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.clean(few, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_item_at_the_end_of_a_very_long_text():
    items = decontaminate.index([(1, "q7w8e9r0t1")], decontaminate.BUDGET)
    text = "ab " * 4_500_000 + "q7w8e9r0t1"
    assert set(decontaminate.matches([text], items)) == {(0, 0, len(text) - 10, len(text), 0)}


@pytest.mark.parametrize("pairs", [1, 50, 1 << 21])
def test_pairs_counted_in_slices(monkeypatch, pairs):
    items = decontaminate.index([(1, "la " * 30 + "end"), (2, "what is the tallest mountain of the country"), (3, "la " * 12)], decontaminate.BUDGET)
    texts = ["la " * 90 + "end", "he asked what is the tallest montain of the country " * 3, "", "nothing of it"]
    want = set(decontaminate.matches(texts, items))
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    assert set(decontaminate.matches(texts, items)) == want and {m[:2] for m in want} >= {(0, 0), (1, 1), (0, 2)}


def test_mixing_keeps_to_weights(spark):
    rows = [(i if i % 50 else None, f"t{i}", random.Random(i).choice(["a", "a", "a", "b", "c", None, "d"]), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string").repartition(5)
    weights, block = {"a": 5, "b": 2}, 8
    got = mixing.mixed(docs, weights, 3, block).orderBy("_position").collect()
    assert [r._position for r in got] == list(range(3000))
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    heads = {}
    for r in got:
        heads.setdefault(r._slot, r._class)
    assert len(heads) == len({(r._class, r._block) for r in got})
    seen, total = {"a": 0, "b": 0, "(other)": 0}, 10
    for t in range(max(heads)):
        if t not in heads:
            break
        seen[heads[t]] += 1
        assert all(abs(seen[c] - (t + 1) * w / total) < 1 for c, w in {"a": 5, "b": 2, "(other)": 3}.items())
    assert mixing.in_order(docs, weights, 3, block).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 7}, {"x": 13, "y": 8, "z": 5, "w": 31}])
def test_schedule_meets_deadlines(spark, weights):
    total = sum(weights.values())
    for r in mixing.schedule(spark, weights).collect():
        assert r.nth * total // r.weight <= r.slot < -(-(r.nth + 1) * total // r.weight)


def test_language(spark):
    rng = random.Random(1)
    lexicon = {"en": "the and with from that house river stone".split(), "de": "der und mit von dass haus fluss stein".split(), "fr": "le et avec de que maison rivière pierre".split()}
    rows = [(i, " ".join(rng.choices(lexicon[lang], k=rng.randint(3, 60))), lang, f"src{i % 5}") for i in range(600) for lang in [rng.choice(list(lexicon))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs.filter("doc_id < 300"))
    found = {r.id: r.language for r in language.identify(language.evidence_of_documents(docs), model).collect()}
    assert np.mean([found[r[0]] == r[2] for r in rows if r[0] >= 300]) > 0.98
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "en", "x"), (3, "0x7f 8 9 %% ## 12345 67890 " * 20, None, "src1"), (None, "the river and the house with that stone", None, None), (5, '<html lang="de"> haus stein und fluss', None, "y")], "doc_id long, text string, lang string, source string")
    kept = {r.id: (r.language, r.rejected) for r in language.identify(language.evidence_of_documents(odd), model).collect()}
    assert kept[1] == kept[2] == kept[3] == ("und", True)
    assert kept[None] == ("en", False) and kept[5] == ("de", False)
    empty = docs.limit(0)
    assert language.known_language(empty).count() == 0
    assert language.known_language(odd.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang", "source")).count() == 5


def test_language_sample_counts_copies_once(spark):
    docs = spark.createDataFrame([("ab", "en")] * 500 + [("ab", "fr"), ("cd", "de"), (None, "en"), ("ef", None)], "text string, lang string").repartition(4)
    model = language.train(docs, 2)
    assert model.languages == ["de", "en"]
    assert np.isclose(np.exp(model.table[:, 1]).max(), 1.5 / (language.BINS / 2 + 1), rtol=1e-3)
    assert len(language.train(docs, 1).languages) == 1


def test_language_sample_holds_rare_languages(spark):
    rng = random.Random(6)
    words = {"en": "the and with from that house river stone".split(), "fi": "ja tai joki talo kivi yhdessä mutta kuin".split(), "pl": "oraz dom rzeka kamień który przez tylko jest".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i in range(3000) for lang in ["fi" if i % 1000 == 7 else "pl" if i % 300 == 3 else "en"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("x")).repartition(4)
    model = language.train(docs, 30)
    assert model.languages == ["en", "fi", "pl"]
    picked = language._sampled(docs.select(F.xxhash64("text").alias("h"), "lang"), 30)
    by = {lang: sorted(r.h for r in docs.filter(F.col("lang") == lang).select(F.xxhash64("text").alias("h")).collect()) for lang in words}
    want = {*by["fi"], *by["pl"][:10], *by["en"][: 30 - 3 - len(by["pl"][:10])]}
    assert len(picked) == len({h for h, in picked}) == 30 and len(by["fi"]) == 3 and len(by["pl"]) == 10
    assert {h for h, in picked} == want
    assert language.train(docs, 30).table.tolist() == model.table.tolist()
    found = {r.id: (r.language, r.rejected) for r in language.identify(language.evidence_of_documents(docs), model).collect()}
    assert all(found[i] == (lang, False) for i, _, lang in rows if lang != "en")


def test_language_of_pages(spark):
    base = [(i, "the and with from that house river stone", "en", "a") for i in range(30)] + [(99 + i, "der und mit von dass haus fluss stein", "de", "b") for i in range(30)]
    model = language.train(spark.createDataFrame(base, "doc_id long, text string, lang string, source string"))
    pages = spark.createDataFrame([(1, "http://x.example.com/de/1", "<html><p>ok</p></html>"), (2, "http://y.example.org/", '<html lang="en"><script>der und mit</script>no</html>'), (3, None, None)], "page_id long, url string, html string")
    found = {r.id: r.language for r in language.identify(language.evidence_of_pages(pages), model).collect()}
    assert found == {1: "de", 2: "en", 3: "und"}


def test_shards(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["The", "it's", "house,", "naïve", "É́", "<|endoftext|>", "x y", "12", "don't.", "...", "a.b,", "<|ENDOFTEXT|>", "Σας"], k=rng.randint(0, 40))) for _ in range(400)] + [None, "", "\n"]
    ids = rng.sample(range(-1000, 100_000), len(texts) - 3) + [None, 5, 5]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    tokenizer = Tokenizer.from_file(WORDS)
    manifest = sstable.write_shards(docs, WORDS, fresh_path(spark, "test-shards"), shard_bytes=4000)
    assert manifest.count() > 5
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    rows = sstable.read_shards(manifest, True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r.start == at and r.ids in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    paths = [r.path for r in manifest.collect()]
    for i in rng.sample([x for x in ids if x is not None], 30):
        assert sorted(x.tolist() for p in paths for x in sstable.ShardReader(p).get(i)) == sorted(want[i])
    assert sum(len(sstable.ShardReader(p).get(10**9)) for p in paths) == 0
    assert sstable.token_table(docs.limit(0), WORDS).count() == 0
