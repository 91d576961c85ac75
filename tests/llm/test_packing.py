"""Packing: ids against the tokenizer itself, cuts against a plain dynamic programme, pieces put together again."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n\t ", "Hello, world. It's ready! I've 42 x's", "ÉCOLE Straße İstanbul ΣΊΣΥΦΟΣ", "étude É.", "日本語。テキスト！ ok", "a\x1cb\x1f c\x85d\xa0e f",
    "<|endoftext|> x<|startoftext|>. Y", "<|ENDOFTEXT|>A <|EndOfText|>", "J\u030cA A\u0301b.C\u0301", "...!!! 'Tis 'll's,", "😀 fun​ny\r\nline\x0b\x0cend", "K K ﬁ", "don't.stop,now 3.14 a.b.c.", "x" * 300 + ". " + "Y" * 70 + "!",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


def ids_of(ids, texts):
    """The ids of each text by the operator, without the end id."""
    got, ends, stop, docs = ids.texts(pa.array(texts, pa.string()))
    assert len(ends) == len(stop) and docs[-1] == len(got) and (got[docs - 1] == 2).all()
    return [part[:-1].tolist() for part in np.split(got, docs[:-1])]


def test_ids_are_the_tokenizers(plain):
    ids = packing.Ids(FILE)
    for texts in ([t] for t in ODD):
        assert ids_of(ids, texts) == [plain.encode(texts[0], add_special_tokens=False).ids], texts
    for texts in (ODD, [*ODD, None, " ".join(ODD)], [""], [None, ""]):
        assert ids_of(ids, texts) == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAJsS'.,!? \n<|>1\u030c\u0301")), max_size=40), min_size=1, max_size=3))
def test_ids_of_any_text(texts):
    one = packing.tokenizer(FILE)
    assert ids_of(one, texts) == [one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_and_learned_again(plain, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3)
    ids = packing.Ids(FILE)
    for t in ODD * 2:
        assert ids_of(ids, [t]) == [plain.encode(t, add_special_tokens=False).ids]


def test_sentences_and_lines_end_words():
    ids = packing.Ids(FILE)
    text = 'One two. He said "no!" and\nleft 3.14 a.b.c 終わり。 end'
    got, ends, stop, docs = ids.texts(pa.array([text, "", "x"]))
    before = {int(e) for e in ends[stop]}
    want = {len(ids.tokenizer.encode(text[: text.index(m) + len(m)], add_special_tokens=False).ids) for m in ("two.", 'no!"', "and", "。")} | {int(docs[0]) - 1}
    assert before == want | {int(docs[1]) + 1}


def cost_of(lengths, costs, window):
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths) + sum(costs)


def slow_cuts(at, cost, window):
    """(least cost, fewest windows) of all ways, by trying every pair of places."""
    where, best = [0, *at], [(0, 0)]
    for j in range(1, len(where)):
        best.append(min((best[i][0] + cost[j - 1] + cost_of([where[j] - where[i]], [], window), best[i][1] + 1) for i in range(j) if where[j] - where[i] <= window))
    return best[-1]


def test_cuts_cost_least():
    draw = random.Random(2)
    for _ in range(400):
        window = draw.choice([8, 16, 64])
        at = np.cumsum([draw.randint(1, draw.choice([3, window])) for _ in range(draw.randint(1, 60))])
        cost = np.array([draw.choice([0, 1, 4, 16]) for _ in at])
        ends = packing.cuts(at, cost, True, window)
        lengths = np.diff([0, *at[ends]])
        assert at[ends][-1] == at[-1] and lengths.max() <= window
        assert (cost_of(lengths.tolist(), cost[ends].tolist(), window), len(ends)) == slow_cuts(at.tolist(), cost.tolist(), window)


def test_an_open_block_ends_near_its_end():
    draw = random.Random(4)
    for _ in range(100):
        at = np.cumsum([draw.randint(1, 16) for _ in range(50)])
        ends = packing.cuts(at, np.ones(50, int), False, 16)
        assert 0 <= at[-1] - at[ends[-1]] <= 16 and np.diff([0, *at[ends]]).max() <= 16


def test_places_are_sentence_ends_and_words_in_long_stretches():
    ends, stop = np.array([5, 9, 300, 301, 420, 423]), np.array([True, False, False, True, True, True])
    at, cost = packing.places(ends, stop, np.array([421, 422, 424]))
    by = dict(zip(at.tolist(), cost.tolist()))
    assert by[421] == by[422] == by[424] == 0 and np.diff([0, *at]).max() <= 2 * packing.STRETCH
    assert by[5] == by[301] == packing.SENTENCE and 420 not in by and 423 not in by
    assert {c for p, c in by.items() if p not in (5, 301, 421, 422, 424)} == {packing.INSIDE}
    assert packing.places(np.empty(0, int), np.empty(0, bool), np.array([1]))[0].tolist() == [1]


def whole(rows, texts, plain, window=packing.WINDOW):
    """Pieces make every document again, sequences have no gaps; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(r.length for r in rows)


def test_packs_the_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed(docs).collect()
    assert whole(rows, {r.doc_id: r.text for r in docs.collect()}, plain) < 0.01
    by_order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in by_order))
    assert order == [r.doc_id for r in docs.select("doc_id").collect()]


def test_cases(spark, plain):
    texts = dict(enumerate(ODD)) | {100: None, 101: "word " * 20_000, 102: "Q" * 30_000, 103: "One. Two.\nThree"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "length", "offset", "ids")})
    for block in (1 << 20, 5000, 700):
        rows = packing.packed(df, make=lambda first, block=block: packing.Packer(first, block)).collect()
        whole(rows, texts, plain)
    assert packing.packed(df.limit(0)).collect() == []
    none = spark.createDataFrame([(None, None), (None, "a b"), (7, "c"), (7, "c")], "doc_id long, text string")
    rows = packing.packed(none).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if not r.start) == [("7", 2), ("7", 2), ("None", 1), ("None", 3)]


def test_tasks_have_sequences_of_their_own(spark, plain):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words. "), F.col("id").cast("string")).alias("text")).repartition(5)
    rows = packing.packed(df).collect()
    whole(rows, {i: f"some words. {i}" for i in range(40)}, plain)
    assert len({r.sequence_id >> 33 for r in rows}) > 1


def test_ids_of_slices_of_a_batch(plain):
    """Pieces of an Arrow batch are slices: their texts begin anywhere in its buffers."""
    ids, texts = packing.Ids(FILE), [*ODD[:8], None, *ODD[8:]]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for start in range(0, len(texts), 2):
            part = column.slice(start, 3)
            got, _, _, docs = ids.texts(part)
            want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in part.to_pylist()]
            assert [p.tolist() for p in np.split(got, docs[:-1])] == want
