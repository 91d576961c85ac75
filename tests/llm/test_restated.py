"""Operators against independent restatements, and cases that need a table of their own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import common, html, language, licences, toxicity

SYLLABLES = "the er on an re ha ing st or en ea ti ed is wh ou".split()


def prose(draw, n):
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n))


def test_composed_transducers_equal_four_readers():
    """Each pattern by looking back and ahead in the clause, without any state."""
    to, out = toxicity.compose()
    draw = random.Random(3)
    insult, threat, target, negation, report, _ = range(6)
    for _ in range(4000):
        clause = [draw.choice([insult, threat, target, negation, report, 5, 5, 5]) for _ in range(draw.randint(1, 14))]
        state, got = 0, []
        for c in clause:
            got.append(sorted(out[state][c]))
            state = to[state][c]
        want = [[] for _ in clause]
        for i, c in enumerate(clause):
            if c not in (insult, threat):
                continue
            hit = (c, int(negation in clause[max(0, i - 3) : i]), int(report in clause[:i]))
            aimed = target in clause[max(0, i - 4) : i]
            want[i].append((*hit, int(aimed)))
            if not aimed:  # the first target within four words, unless another hit comes before it
                for j in range(i + 1, min(len(clause), i + 5)):
                    if clause[j] == target:
                        want[j].append((*hit, 1))
                    if clause[j] in (insult, threat, target):
                        break
        assert got == [sorted(w) for w in want]


def profile(text):
    """n-grams of a text by frequency, then shorter first and by code points (a word's end sorts first)."""
    found = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = "\x00" + word + "\x00"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if g != "\x00":
                    found[g] = found.get(g, 0) + 1
    return sorted(found, key=lambda g: (-found[g], len(g), g))[: language.LENGTH]


def test_language_predictions_restated(spark):
    draw = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "jklmnop"}
    word = lambda k: "".join(draw.choices(alphabets[k], weights=range(7, 0, -1), k=draw.randint(1, 6)))
    docs = [(i, " ".join(word(k) for _ in range(draw.randint(1, 40))), k) for i, k in enumerate(draw.choices(list(alphabets), k=240))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = df.where(common.fold(F.col("doc_id")) != 1).collect()
    own = {k: profile(" ".join(r.text for r in learned if r.lang == k)) for k in alphabets}
    got = {r.doc_id: r for r in language.labelled(df).collect()}
    for i, text, _ in docs:
        p = profile(text)
        far = {k: sum(abs(r - q.index(g)) if g in q else language.LENGTH for r, g in enumerate(p)) / (language.LENGTH * len(p)) for k, q in own.items()}
        assert got[i].lang_pred == min(far, key=lambda k: (far[k], k))
        assert abs(got[i].score - (1 - min(far.values()))) < 1e-12


def test_ties_of_languages_go_by_code_points(spark):
    df = spark.createDataFrame([(i, "same words here", k) for i, k in enumerate(["zz", "mm", "aa"] * 8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.labelled(df).collect()} == {"aa"}


def test_rare_languages_are_learned(spark):
    draw = random.Random(5)
    docs = [(i, prose(draw, 8), "en") for i in range(3000)] + [(5000 + i, "ŷŵ ŵŷŷ ŵ", "rare") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert set(language.fit(df, most=50)) == {"en", "rare"}


def test_ties_of_licences_go_by_name():
    table = licences.compiled({"B": ("permission to use this work is granted",), "A": ("permission to use this work is granted",)})
    assert licences.scan("Permission to use this work is granted.", table, 0.8) == [("A", 1.0)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_pages_without_an_id_keep_their_own_text(spark, most):
    rows = [(None, f"https://a.org/{i}", f"<body><div>Menu of a.org</div><article><p>Text {i}</p></article></body>") for i in range(12)] + [(1, None, None), (1, "", "<p>x")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").withColumns({"keys": F.lit("x"), "site": F.lit(1)})
    got = sorted(r.text for r in html.main_text(df, most=most).collect())
    assert got == sorted([f"Text {i}" for i in range(12)] * 2 + ["", "x"] * 2)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_and_take_empty_tables(spark, name, stage):
    draw = random.Random(6)
    rows = [(i, prose(draw, 30), "en", "a", 10) for i in range(6)] + [(None, None, None, None, None), (9, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({"node": F.lit(1), "key": F.lit("k"), "row": F.lit(2.0)})
    for df in (docs, docs.limit(0)):
        out = stage(spark, df, "")
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    assert rows == []


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 10, "d"])], names=["id", "text"])
    assert [p.num_rows for p in common.pieces(batch, 1, 20)] == [2, 1, 3]
    assert [p.num_rows for p in common.pieces(batch, 1, 1)] == [1, 1, 1, 1, 1, 1] or sum(p.num_rows for p in common.pieces(batch, 1, 1)) == 6
    assert common._bytes("8m") == 8 << 20 and common._bytes("64b") == 64 and common._bytes("x") == -1


def test_licences_by_name_and_denial():
    table = licences.compiled(licences.TEMPLATES)
    named = lambda text: [n for n, _ in licences.scan(text, table, 0.8)]
    assert named("Licensed under the GNU Lesser General Public License v3.0.") == ["LGPL-3.0"]
    assert named("Licensed under the GNU Lesser General Public License, version 2.1") == ["LGPL-2.1"]
    assert named("Released under the GNU Affero General Public License v3.0!") == ["AGPL-3.0"]
    assert named("Licensed under the GNU General Public License v3.0.") == ["GPL-3.0"]
    assert named("Distributed under the MIT license.") == ["MIT"]
    assert named("This project is licensed under the terms of the Mozilla Public License 2.0.") == ["MPL-2.0"]
    assert named("Released under the Unlicense.") == ["Unlicense"] and named("Released under the CC0 1.0 Universal Public Domain Dedication.") == ["CC0-1.0"]
    for name in licences.TEXTS:
        assert name in named("Before.\n" + max(licences.TEXTS[name], key=len) + "\nAfter."), name
    assert named("not licensed under the MIT License") == [] and named("This project is not licensed under the terms of the MIT license.") == []
    assert named("It is no longer released under the MIT License.") == []
    assert named("This project is licensed under the terms of the Foo license.") == [] and named("Licensed under the") == []
    assert named("No warranty. Licensed under the MIT License.") == ["MIT"] and named("Comes without fees; released under the MIT License.") == ["MIT"]
