import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidewright.llm import mixing, sstable
from tidewright.llm.common import fresh_path


def test_stages_filter_and_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= n
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(got) <= n and len({r.doc_id for r in got}) == len(got)


def test_token_shards_follow_the_mix(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, sf).orderBy("start").collect()]
    placed = mixing.mixed(docs.join(spark.createDataFrame([(i,) for i in got], "doc_id long"), "doc_id", "left_semi"))
    assert got == [r.doc_id for r in placed.orderBy("_position").collect()] != sorted(got)


def test_ordered_shards_find_ids(spark):
    docs = spark.createDataFrame([(i if i else None, f"word {i}", (i * 7) % 50) for i in range(50)], "doc_id long, text string, place long").repartition(3)
    manifest = sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "test-ordered"), shard_bytes=80, order="place")
    rows = sstable.read_shards(manifest, True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs.orderBy("place").collect()]
    readers = [sstable.ShardReader(r.path) for r in manifest.collect()]
    for r in rows:
        assert [x.tolist() for reader in readers for x in reader.get(r.doc_id)] == [r.ids]


def plain_order(rows, weights, other, block):
    """(doc_id, source) rows in the order of earliest deadlines among released blocks; classes that run out are passed over."""
    classes = {c: [] for c in [*weights, "(other)"]}
    for i, source in sorted(rows):
        classes[source if source in weights else "(other)"].append(i)
    share = {**weights, "(other)": other}
    total, done, out, t = sum(share.values()), dict.fromkeys(share, 0), [], 0
    while any(len(classes[c]) > done[c] * block for c in share):
        free = [c for c in sorted(share) if done[c] * total // share[c] <= t]
        pick = min(free, key=lambda c: (-(-(done[c] + 1) * total // share[c]), c))
        out += classes[pick][done[pick] * block : (done[pick] + 1) * block]
        done[pick] += 1
        t += 1
    return out


def test_run_matches_plain_python(spark, tmp_path):
    rng = random.Random(12)
    words = {"en": [f"en{chr(97 + i)}{chr(97 + j)}ing" for i in range(12) for j in range(12)], "de": [f"sch{chr(97 + i)}{chr(97 + j)}ung" for i in range(12) for j in range(12)]}
    item = "what is the tallest mountain of the whole country and who climbed it first"
    rows, alike, leaks = [], {}, set()
    for i in range(400):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang], k=rng.randint(20, 60)))
        if i % 10 == 3 and i > 20:
            first = rng.choice([j for j in range(i) if j not in alike and j not in leaks and rows[j][1]])
            text = rows[first][1] if i % 20 == 3 else rows[first][1] + " " + rng.choice(words[lang])
            alike[i] = first
        elif i % 17 == 5:
            text, _ = f"{text} {item.upper()}, {text[:20]}", leaks.add(i)
        elif i % 50 == 7:
            text = rng.choice([None, "", "12 34 %%"])
        rows.append((i, text, lang, rng.choice(["src0", "src0", "src0", "src1", "src2", "src3", "src9", None]), len(text or ""), "x"))
    docs = spark.createDataFrame([*rows, rows[11], rows[11]], "doc_id long, text string, lang string, source string, n_chars long, _position string").repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    kept = []
    for i, text, *_ in rows:
        if text and any(c.isalpha() for c in text) and not any(len(sets(text) & sets(rows[j][1])) >= 0.8 * len(sets(text) | sets(rows[j][1])) for j in kept):
            kept.append(i)
    kept = [i for i in kept if i not in leaks]
    assert len(kept) == 400 - len(alike) - len(leaks) - sum(not (r[1] and any(c.isalpha() for c in r[1])) for r in rows)
    want = plain_order([(i, rows[i][3]) for i in kept], mixing.WEIGHTS, mixing.OTHER_WEIGHT, mixing.BLOCK)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect(), 0
    assert [r.doc_id for r in got] == want
    for r in got:
        ids = [*tokenizer.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None, None), (None, "some words of a text without an id", None, None, 1), (None, "some words of a text without an id", None, None, 1), (5, "a text of one id", "en", "src0", 2), (5, "and quite another text under it", "en", "src0", 2)]
    schema = "doc_id long, text string, lang string, source string, _tag long"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path)).persist()
            assert docs.columns == ["doc_id", "text", "lang", "source", "_tag"]
        assert sorted(str(r.text) for r in docs.collect()) == sorted({r[1] for r in rows if r[1]})
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
