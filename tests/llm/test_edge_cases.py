"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names: no operator crashes,
and each case has its stated result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import ann, html, jaccard, language, licences, lines, mixing, quality, sentencepiece, toxicity

#: Names that operators use inside.
CLASH = ("row", "node", "of", "size", "rank", "guess", "w", "t", "stratum", "key", "target", "removed", "all", "stay", "dd_id", "goal_source", "times", "ids", "keys", "score", "line", "first", "component_id")
SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank while many people watch it run away quickly"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, SENTENCE, "en", "a", 1),
        (2, SENTENCE, "en", "a", 1),
        (2, SENTENCE, "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t\n ", "en", "b", 5),
        (6, "?!? 123 ...", "en", None, 5),
        (7, LONG, "en", "b", 5),
        (8, "z" * 50_000, None, "b", 5),
        (None, "a row without an id but with words", "en", "c", 5),
        (None, None, None, None, None),
        (9, "日本語 text 😀 with \x00 and   signs\r\nand lines", "xx", "c", 5),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({f"{c}": F.lit(f"extra {c}") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (7, None, None, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


def none(df):
    return df.limit(0)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 12 and all(r.taken <= 2 * r.size for r in rows)
    assert {r.taken for r in rows if r.doc_id in (3, 4, 5)} == {0}
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none(docs)).collect() == []
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(none(docs)).count() == 0


def test_quality(docs, labels):
    rows = quality.judge(docs, labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[8].n_words == 1 and by[7].n_words == 30_000
    assert len(quality.judge(docs, none(labels)).collect()) == 12
    assert quality.judge(none(docs), labels).collect() == []


def test_language(docs):
    rows = {r.doc_id: r for r in language.labelled(docs).collect()}
    assert {rows[i].lang_pred for i in (3, 4, 5, 6)} == {"und"} and rows[1].lang_pred != "und"
    assert language.labelled(none(docs)).collect() == []
    kept = language.kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, 9, None}
    assert language.kept(none(docs)).count() == 0
    assert {r.lang_pred for r in language.labelled(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(docs, labels):
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len(toxicity.scored(docs, none(labels)).collect()) == 12
    assert toxicity.scored(none(docs), labels).collect() == []


def test_licences(docs):
    rows = {r.doc_id: r.licences for r in licences.scanned(docs).collect()}
    assert rows[3] == rows[4] == rows[7] == []
    assert licences.scanned(none(docs)).collect() == []


def test_sentencepiece(docs):
    rows = sentencepiece.encoded(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[3].ids == [] and by[3].same is None and by[4].same
    assert all(by[i].same for i in (1, 5, 6, 7, 8, 9))
    back = sentencepiece.decoded(sentencepiece.encoded(docs.where("text is not null"))).collect()
    assert {r.text for r in back} == {r.text for r in docs.where("text is not null").collect()}
    assert sentencepiece.encoded(none(docs)).collect() == []


def test_lines(docs):
    rows = lines.deduped(docs).collect()
    assert len(rows) == 12
    by = {r.row.doc_id: r for r in rows if r.row.doc_id is not None}
    assert by[1].removed == [] and by[2].removed == [0] and by[2].row.text == "" and by[3].row.text is None
    assert by[5].removed == [] and by[5].row.text == " \n\t\n " and by[2].row.of == "extra of"
    kept = lines.kept(docs)
    assert kept.columns == docs.columns and 2 not in {r.doc_id for r in kept.collect()}
    assert lines.kept(none(docs)).count() == 0


def test_jaccard(docs):
    rows = jaccard.joined(docs).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 12 and {(1, 19, 1), (2, 19, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (None, 5, None), (None, 0, None)} <= got
    assert jaccard.joined(none(docs)).collect() == []
    one = jaccard.one_each(docs, 5, 80)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_ann(spark):
    v = [float(i) for i in range(1, 9)]
    rows = [(0, v), (1, v), (2, [2 * x for x in v]), (3, None), (4, [0.0] * 8), (5, [1.0, None] * 4), (6, [float("nan")] * 8), (7, [float("inf")] + v[1:]), (8, [-x for x in v]), (50, [1.0] * 8), (50, [1.0] * 8), (100, [1.0, 2.0, 3.0]), (150, []), (None, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "v": F.lit("x"), "score": F.lit("y")})
    got = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert [x[1] for x in got[0]] == [1, 2, 50, 8] and [x[0] for x in got[0]] == [1, 2, 3, 4]
    assert got[0][0][2] == 1.0 and got[0][3][2] == -1.0
    assert set(got) == {0, 50}  # 100 has no vector of its length beside it
    assert ann.neighbours(df.limit(0)).collect() == []


def test_html(spark):
    rows = [(1, "http://a.org/1", None), (2, None, ""), (3, "x", "<article><p>A &amp;amp; B<p>c <b>d<br>e</article>"), (3, "x", "plain < text"), (None, "http://a.org/2", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = html.main_text(df).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert "A &amp; B\n\nc d e" in {r.text for r in got if r.page_id == 3}
    assert next(r for r in got if r.page_id is None).n_chars == 5 * 50_000 - 1
    assert html.main_text(df.limit(0)).collect() == []


def test_stages_keep_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
