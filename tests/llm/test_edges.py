"""Null ids, repeated rows, very long texts and columns of clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewright.llm import chat, decontaminate, mixing, simhash, sstable

WORDS = public_tokenizers.path("word_bpe_49k.json")


def long_text(n, seed=1):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))


def test_decontaminate_odd_rows(spark):
    item = "what is the tallest mountain of the whole country"
    rows = [(None, f"he asked {item} twice", 1, 2), (None, "clean one", 1, 2), (None, None, 1, 2), (4, f"{long_text(60_000)} {item}", 1, 2), (5, "yes it is", 1, 2), (5, "yesterday was", 1, 2), (6, "clean one", 1, 2), (6, "clean one", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, one long, _leak long")
    bench = spark.createDataFrame([(1, item), (None, item), (2, "Yes!"), (3, None), (4, " ?! ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(None, 1, 0), (None, None, 0), (4, 1, 0), (4, None, 0), (5, 2, 0)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("5", "yesterday was"), ("6", "clean one"), ("6", "clean one"), ("None", "None"), ("None", "clean one")]


def test_decontaminate_in_several_passes(spark, monkeypatch):
    items = [(i, f"question number {w} of the list of many questions") for i, w in enumerate(["one", "two", "three", "four", "seventeen"])]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items] + [(9, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 60)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole and {r[0] for r in whole} == set(range(5))


def test_short_items_keep_their_budget(spark):
    items = [(1, "abcdefghijklmnopqrst"), (2, "zyxwvutsrqponm")]
    docs = [(1, "xx abcdeXghijklmnopYrst xx"), (2, "xx abcdXfghXjklmXopqrst xx"), (3, "xx zyxwvutXrqponm xx"), (4, "xx zy9wvut9rqponm xx")]
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1, 2), (3, 2, 1)}


def test_bit_vectors_agree_with_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choices("abc", k=rng.randrange(1, 30)))
        text = "".join(rng.choices("abc", k=rng.randrange(0, 40)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
        for budget in range(4):
            codes = decontaminate.units(item)
            assert decontaminate.within(decontaminate.masks(codes), len(codes), decontaminate.units(text).tolist(), budget) == (min(row) <= budget)


def test_simhash_of_long_texts(spark):
    text = long_text(150_000)
    rows = [(1, text, 7), (2, text + " tail", 7), (3, long_text(150_000, 2), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert simhash.one_of_each(docs).columns == docs.columns


def test_chat_of_long_texts(spark):
    text = long_text(100_000) + " <|im_end|> \\n"
    turns = spark.createDataFrame([(1, 0, "user", "x", 5), (1, 1, "assistant", text, 5)], "conv_id long, turn long, role string, text string, turns int")
    r = chat.digest(chat.format_conversations(turns)).first()
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_shards_of_long_texts_and_clashing_names(spark):
    rows = [(3, long_text(30_000), "a", 1), (3, "same id", "b", 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, low int")
    got = sstable.token_table(docs, WORDS).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = {zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t, *_ in rows}
    assert {r.ids_crc32 for r in got} == want and [r.doc_id for r in got] == [None, 3, 3]


def test_mix_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"t{i}", "src0", 70 + i, 1, 2) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _rank int, _position int, row int")
    assert sorted(map(tuple, mixing.in_order(docs).collect())) == rows and mixing.in_order(docs).columns == docs.columns
    assert [r._position for r in mixing.mixed(docs).orderBy("doc_id").collect()] == list(range(5))
