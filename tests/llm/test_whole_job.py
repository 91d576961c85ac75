"""Cases that a cut of the work would lose."""

import glob
import os
import random
import tempfile
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, components, html, jaccard, licences, lines, mixing, quality
from lodestar.sources import scratch

SYLLABLES = "the er on an re ha ing st or en ea ti ed is wh ou".split()


P = "<p>The first paragraph of the article.</p><p>The second one.</p>"
TEXT = "The first paragraph of the article.\n\nThe second one."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><div class="layout has-sidebar"><article>{P}</article><div class="sidebar">Side</div></div>', TEXT),
        (f'<body><div class="no-comments post"><main>{P}</main></div>', TEXT),
        (f'<body><article><section class="post-header"><h1>Title</h1></section>{P}</article>', "Title\n\n" + TEXT),
        ('<body><article><p id="follow-up">One.</p><p class="ad-free">Two.</p><div id="search-strategy"><p>Three.</p></div></article>', "One.\n\nTwo.\n\nThree."),
        ("<body><article><p>One.</p></article><article><p>Two, longer.</p></article>", "One.\n\nTwo, longer."),
        ("<body><main><h1>Head</h1><article><p>One.</p></article><p>Beside.</p><nav>Menu</nav></main><footer>F</footer>", "Head\n\nOne.\n\nBeside."),
        (f'<body><div class="widget"><article>{P}</article></div><div class="widget">Other</div>', TEXT),
        (f'<body><article>{P}<div class="comments"><p>Nice</p></div></article><section id="comments"><article class="c"><p>Bad</p></article></section>', TEXT),
        (f'<body><div class="cookie banner">Cookies</div><header>H</header><article><header><h1>T</h1></header>{P}<form>F</form><aside>A</aside></article>', "T\n\n" + TEXT),
        ("<body><main></main><article><p>Beside an empty main.</p></article>", "Beside an empty main."),
        ("<body><p>No article &amp; no main.</p><footer>F</footer>", "No article & no main."),
    ],
)
def test_articles_are_whole(page, want):
    assert html.extract("https://a.org/x", page, frozenset()) == want
    assert html.extract("https://a.org/x", page, frozenset({1})) == want


def test_subtrees_counted_by_another_parser(spark):
    """Templates of two hosts by the standard parser and plain counts against the operator's."""
    from collections import Counter, defaultdict
    from html.parser import HTMLParser

    draw, rows = random.Random(8), []
    for site, shared in (("one.org", 3), ("two.org", 5)):
        for i in range(40):
            common = "".join(f"<div><span>Part {site} {k}</span><div>deep {k}</div></div>" for k in range(shared) if draw.random() < 0.6)
            own = "".join(f"<div>{prose(draw, 8)}</div>" for _ in range(3))
            rare = f"<div>rare {i % 20}</div>"  # on two pages each
            rows.append((len(rows), f"https://{site}/{i}", f"<html><body>{common}{own}{rare}<div>Part one.org 0</div></body></html>"))

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.all = [["root", []]], []

        def handle_starttag(self, tag, attrs):
            self.stack.append([tag, []])

        def handle_endtag(self, tag):
            tag, parts = self.stack.pop()
            node = (tag, tuple(parts))
            self.stack[-1][1].append(node)
            self.all.append(node)

        def handle_data(self, data):
            self.stack[-1][1].append(data)

    def tree(page):
        t = Tree()
        t.feed(page)
        return t

    seen, pages = defaultdict(Counter), Counter()
    for _, url, page in rows:
        site = url.split("/")[2]
        pages[site] += 1
        seen[site].update({n for n in tree(page).all if n[0] == "div"})
    template = {s: {n for n, k in c.items() if k >= html.MANY and k >= html.SHARE * pages[s]} for s, c in seen.items()}

    def blocks(node, site):
        out, line = [], []
        for p in node[1]:
            if isinstance(p, str):
                line.append(p)
            elif p[0] == "div":
                out.append("".join(line))
                line = []
                out += [] if p in template[site] else blocks(p, site)
            else:
                line.append("".join(p[1]))
        return [b for b in [*out, "".join(line)] if b]

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for i, url, page in rows:
        body = next(n for n in tree(page).all if n[0] == "body")
        want[i] = "\n\n".join(blocks(body, url.split("/")[2]))
    assert any("rare" in t for t in want.values()) and not any("deep" in t for t in want.values())
    for most in (200_000, 0):
        assert {r.page_id: r.text for r in html.main_text(df, most=most).collect()} == want


def prose(draw, n):
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0"])
def test_licence_paragraphs_inside_a_larger_text(name):
    draw, table = random.Random(1), licences.compiled(licences.TEMPLATES)
    text = max(licences.TEMPLATES[name], key=len)
    inside = f"{prose(draw, 300)}\n\nCopyright (c) 2020 X\n\n{text.replace('. ', '.\n\n')}\n\n{prose(draw, 300)}"
    assert dict(licences.scan(inside, table, 0.8))[name] > 0.95
    assert dict(licences.scan(inside.replace("\n", " "), table, 0.8))[name] > 0.95


def test_licence_notice_inside_a_line():
    table = licences.compiled(licences.TEMPLATES)
    assert licences.scan("Unless noted otherwise, this project is licensed under the terms of the MIT license and may be copied.", table, 0.8) == [("MIT", 1.0)]
    for sign in ("Copyright 2020", "(c) 2020", "©"):
        assert licences.scan(f"{sign} Jane Doe. Licensed under the BSD License.", table, 0.8) == [("LicenseRef-BSD", 1.0)]
    assert licences.scan("See: this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", table, 0.8) == [("CC-BY-SA-4.0", 1.0)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under the Apache License, Version 3.0.", []),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the GNU General Public License v1.0.", []),
            ("Licensed under the GNU General Public License v2.0.", ["GPL-2.0"]),
        ("Licensed under the GNU General Public License v3.", ["GPL-3.0"]),
        ("Licensed under CC BY 3.0.", []),
        ("Great tool. Released under the MIT License. See docs.", ["MIT"]),
    ],
)
def test_licence_versions_agree(text, want):
    assert [n for n, _ in licences.scan(text, licences.compiled(licences.TEMPLATES), 0.8)] == want


def test_clauses_of_bsd_are_told_apart():
    table = licences.compiled(licences.TEMPLATES)
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC"):
        found = dict(licences.scan(f"Copyright 2020 X\n\n{licences.TEMPLATES[name][0]}\n\nint main() {{}}", table, 0.8))
        assert max(found, key=found.get) == name and found[name] == 1.0


@pytest.mark.parametrize("changed", [1, 2])
def test_lines_at_the_threshold_are_found(spark, changed):
    draw, docs = random.Random(2), []
    for i in range(1500):  # 9 * changed shingles each, of which 8 * changed are shared
        line = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9 * changed + lines.SHINGLE - 1))
        docs.append((i, f"{line[:-changed]}{'0' * changed}\n{line[:-changed]}{'1' * changed}"))
    found = lines.removals(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert found >= 0.985 * len(docs)


def test_one_edit_in_a_line_of_sixty_characters_is_found(spark):
    line = "Last updated on 3 May at noon, see the notes for all changes"
    assert len(line) == 60
    got = lines.removals(spark.createDataFrame([(1, line), (2, line.replace("noon", "noun"))], "doc_id long, text string")).collect()
    assert [(r.dd_id, r.removed) for r in got] == [(2, [0])]


def test_a_null_id_near_copy_does_not_part_a_group(spark):
    draw, docs = random.Random(3), []
    for i in range(20):
        words = prose(draw, 80).split(" ")
        other = lambda at: " ".join([*words[:at], "zzzz", *words[at + 1 :]])
        docs += [(2 * i, other(0)), (2 * i + 1, other(79)), (None, " ".join(words))]
    rows = jaccard.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in rows) == sorted(2 * i for i in range(20) for _ in range(3))


@pytest.mark.parametrize("share", [0.01, 0.03])
def test_large_groups_of_near_copies_lose_no_link(spark, share):
    """One text's copies with edits of their own, and chains of copies of copies: in clusters of all sizes."""
    draw = random.Random(int(share * 1000))
    base = prose(draw, 120).split(" ")
    edit = lambda ws: [w if draw.random() > share else "".join(draw.choices(SYLLABLES, k=4)) for w in ws]
    texts = [edit(base) for _ in range(150)]
    for _ in range(100):
        texts.append(edit(draw.choice(texts)))
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[j : j + 4]) for j in range(len(t) - 3)} for t in texts]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert len({find(i) for i in up}) < len(up)
    got = {r.doc_id: r.component_id for r in jaccard.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def recall(rows, x, every):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    queries = range(0, len(x), every)
    hits = 0
    for q in queries:
        score = unit @ unit[q]
        score[q] = -2
        hits += len(got[q] & set(np.argsort(-score)[: ann.K].tolist()))
    return hits / (ann.K * len(queries))


def test_recall_of_a_full_chunk_of_vectors_without_structure(spark):
    x = np.random.default_rng(5).normal(size=(ann.CHUNK, 64))
    chunk, model = [], ann.train(ann._unit(x[: ann.FIT_ROWS]))
    for at in range(0, len(x), ann.ENCODED):
        chunk.append(model.encode(ann._unit(x[at : at + ann.ENCODED])))
    where, length, code = (np.concatenate(c) for c in zip(*chunk))
    every = 700
    queries = np.arange(0, len(x), every)
    q, v, _ = ann.search(ann.Chunk(np.arange(len(x)), x, where, length.astype(np.float32), code), x[queries], queries, model)
    rows = [type("Row", (), {"query_id": a, "vec_id": b}) for a, b in zip(q.tolist(), v.tolist())]
    assert recall(rows, x, every) >= 0.95


def test_queries_in_blocks_over_several_chunks(spark):
    x = np.random.default_rng(6).normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = ann.neighbours(df, block=13, chunk=700).collect()
    assert len(rows) == ann.K * 60 and recall(rows, x, ann.EVERY) >= 0.99


def test_quality_steps_equal_plain_counts(spark):
    import math

    draw, docs, marks = random.Random(12), [], []
    for i in range(1500):
        lang = draw.choice(["aa", "aa", "aa", "bb", None])
        bad = draw.random() < 0.3
        words = [w + "$" * (draw.random() < (0.4 if bad else 0.01)) + ("QQ" if draw.random() < (0.3 if bad else 0.02) else "") for w in prose(draw, 60).split(" ")]
        docs.append((i, " ".join(words), lang))
        marks.append((i, int(not bad)))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}

    def step(text):
        w = text.split()
        size = max(1, sum(map(len, w)))
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + d for i, s in enumerate(seen) if seen.count(s) > 1 for d in range(3)}
        rate = {"symbol_rate": sum(c in "#*$%&|<>" for c in text) / size, "dup_line_rate": 0.0, "repeat_rate": len(twice) / len(w), "upper_rate": sum("A" <= c <= "Z" for c in text) / size, "word_length": size / len(w)}
        for s in range(quality.STEPS):
            if any(rate[k] > mild * (strict / mild) ** (s / (quality.STEPS - 1)) for k, (mild, strict) in quality.GRID.items()):
                return s
        return quality.STEPS

    first = {i: step(t) for i, t, _ in docs}
    for lang in ("aa", "bb", None):
        own = [i for i, _, x in docs if x == lang]
        held = [first[i] for i in own if marks[i][1] and not got[i].base_failed]
        # the most rejections whose exact upper bound stays within the risk
        n, cdf, most = len(held), 0.0, -1
        for k in range(n + 1):
            cdf += math.comb(n, k) * quality.RISK**k * (1 - quality.RISK) ** (n - k)
            if cdf > quality.ALPHA / 3:
                break
            most = k
        passed = -1
        while most >= 0 and passed + 1 < quality.STEPS and sum(f <= passed + 1 for f in held) <= most:
            passed += 1
        assert {got[i].step for i in own} == {None if passed < 0 else passed}
        for i in own:
            assert got[i].kept == (not got[i].base_failed and first[i] > passed)
    assert any(r.step is not None and not r.kept for r in got.values())


def test_a_repeated_id_with_many_texts_meets_its_target(spark):
    draw = random.Random(9)
    docs = [(7, prose(draw, 20), "a") for _ in range(400)] + [(i, prose(draw, 20), "b") for i in range(100)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    own = [r for r in rows if r.doc_id == 7 and r.source_size == 8000]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 40


def test_targets_of_many_sources(spark):
    draw = random.Random(10)
    sized = [(None if i == 50 else f"s{i:03}", draw.choice([0, 1, 5, 50, 500, 5000])) for i in range(400)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sized, "source string, size long")).collect()}
    size = dict(sized)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, free, want = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = (budget - sum(want.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            free.remove(s)
            want[s] = 2.0 * size[s]
    want |= {s: weight[s] * level for s in free}
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1.0, want[s]) for s in names)


def test_long_lines_by_bins_share_keys(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=1))
    rows, want = [], 0
    for n in (60, 80, 100, 104, 130, 250, 600):
        for _ in range(20):
            line = [word() for _ in range(n)]
            other = list(line)
            for i in range(n // 60):  # each changed character spoils five shingles of either line
                other[i * 60 + 30] = "#"
            rows += [(2 * want, "".join(line)), (2 * want + 1, "".join(other))]
            want += 1
    for some in ("ab cd ef ", "x"):  # few shingles in many places
        rows += [(2 * want, some * 30), (2 * want + 1, some * 300)]
        want += 1
    found = lines.band_keys(spark.createDataFrame(rows, "node long, line string")).collect()
    keys = defaultdict(set)
    for r in found:
        keys[r.node].update(r["keys"])
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(want)) == want
    long_ = [r for r in found if r.node == 2 * (want - 3)]
    assert sorted(len(r["keys"]) for r in long_) == [lines.BANDS // lines.BINS] * lines.BINS  # a shingle meets one bin's factors only


def test_shuffles_and_rounds_leave_no_files(spark):
    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*"))
    before = files()
    scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    folder = scratch.scratch_dir(spark).removeprefix("file:")
    tables = len(os.listdir(folder))
    components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(os.listdir(folder)) == tables + 1


def test_hubs_of_a_component_have_one_reference(spark):
    shared, near = set(range(100)), {}
    hubs = [1000 + i for i in range(3)]
    for i, h in enumerate(hubs):
        near |= {h: shared | {500 + i}} | {2000 + 100 * i + j: shared | {600 + 100 * i + j} for j in range(19)}
    others = {i: set(range(50)) | set(range(10_000 * (i + 1), 10_000 * (i + 1) + 50)) for i in range(9)}
    others[1] = others[0] - {10_000} | {7}
    rows = [("all", h) for h in hubs] + [(f"k{h}", n) for h in hubs for n in [h, *others]] + [(f"f{h}", n) for i, h in enumerate(hubs) for n in [h, *range(2000 + 100 * i, 2019 + 100 * i)]]
    sets = spark.createDataFrame([(n, sorted(s)) for n, s in (near | others).items()], "node long, own array<long>")
    sides = lambda pairs: pairs.join(sets.toDF("a", "own_a"), "a").join(sets.toDF("b", "own_b"), "b")
    size = lambda c: F.size(c).cast("long")
    compare = lambda pairs: sides(pairs).select("a", "b", size("own_a").alias("x"), size("own_b").alias("y"), size(F.array_intersect("own_a", "own_b")).alias("both"))
    asked = []

    def differences(pairs):
        asked.extend(pairs.collect())
        return sides(pairs).select("a", "b", F.array_except("own_a", "own_b").alias("mine"), F.array_except("own_b", "own_a").alias("theirs"))

    members = spark.createDataFrame(rows, "key string, node long")
    got = {r.node: r.component for r in components.resolved(members, compare, differences, 80).collect()}
    assert got == dict.fromkeys(near, 1000) | {0: 0, 1: 0}
    assert sorted(r.a for r in asked) == sorted(others) and len({r.b for r in asked}) == 1  # a row for each node, not for each hub


def test_rows_only_for_classes_that_have_an_element(spark, monkeypatch):
    rows = [(i, 0, 400, 400, i, False, [*range(60), *range(1000 * i, 1000 * i + 40)]) for i in (1, 2)]
    rows += [(3, 0, 400, 400, 3, True, list(range(40)))]
    cluster, made = spark.createDataFrame(rows, "a long, b long, x long, y long, component long, linked boolean, diff array<long>"), []
    monkeypatch.setattr(components, "written", lambda df: made.append(df) or df)
    found = {(r.p, r.q) for r in components.nearby(cluster, 80).collect()}
    assert (1, 2) in found
    (table,) = [df for df in made if "lo" in df.columns]
    assert all(n <= 2 for n in (r["count"] for r in table.groupBy("a", "e").count().collect()))  # two classes hold elements


def test_line_sets_are_hashes_of_code_points(spark):
    texts = ["abcdefgh", "abcdefgx", "ab", "é\U0001f600bcd\U0001f601e", "é\U0001f600bcd\U0001f601f", "aaaaaaaaaa"]
    own = [{s[i : i + lines.SHINGLE] for i in range(max(1, len(s) - lines.SHINGLE + 1))} for s in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "a long, b long")
    got = {(r.a, r.b): (r.x, r.y, r.both) for r in lines.compared(pairs, table).collect()}
    assert got == {(i, j): (len(own[i]), len(own[j]), len(own[i] & own[j])) for i in range(6) for j in range(6)}
    assert lines._sets(pairs, table).schema["own_a"].dataType.elementType.simpleString() == "bigint"


@pytest.mark.parametrize("most", [2, 2048])
def test_marks_spare_comparisons_and_lose_no_link(spark, monkeypatch, most):
    draw, texts = random.Random(5), []
    base = prose(draw, 60).split(" ")
    edit = lambda ws, share: [w if draw.random() > share else "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for w in ws]
    for _ in range(40):
        texts.append(" ".join(edit(base, 0.12)))
    texts += [" ".join(edit(draw.choice(texts[:40]).split(" "), 0.015)) for _ in range(20)]
    sets = [{t[j : j + lines.SHINGLE] for j in range(len(t) - lines.SHINGLE + 1)} for t in texts]
    links = [(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    marks = lines.marked(table).cache(), lines.WORDS
    pairs = spark.createDataFrame([(i, j) for j in range(60) for i in range(j)], "a long, b long")
    open_ = {(r.a, r.b) for r in components.possible(pairs, marks, 80).collect()}
    assert set(links) <= open_ and len(open_ - set(links)) < 300  # of about 1,700 pairs that don't link
    up = list(range(60))
    for i, j in links * 6:  # the least label spreads
        up[i] = up[j] = min(up[i], up[j])
    assert 5 < len(set(up)) < 60
    asked = []
    monkeypatch.setattr(components, "MARKED", most)
    members = spark.createDataFrame([("one", i) for i in range(60)], "key string, node long")
    differences = lambda pairs: asked.append(1) or lines.differences(pairs, table)
    parts = {r.node: r.component for r in components.resolved(members, lambda pairs: lines.compared(pairs, table), differences, 80, marks).collect()}
    assert [parts.get(i, i) for i in range(60)] == up
    assert len(asked) == (most == 2)


def test_keys_of_lines_are_written_once(spark, monkeypatch):
    draw, made, write = random.Random(6), [], lines.written
    texts = [prose(draw, 40) for _ in range(5)] + ["short line", "ab " * 100]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"{t} end" for t in texts)])], "doc_id long, text string")
    monkeypatch.setattr(lines, "written", lambda df: made.append(write(df)) or made[-1])
    assert lines._members(docs, 80).count()
    kept = [df for df in made if "keys" in df.columns or "key" in df.columns and "node" in df.columns]
    assert sum(df.count() for df in kept) == lines.band_keys(lines._lines(docs)).count()


def test_one_each_names_what_goes(spark, monkeypatch):
    draw, asked, small = random.Random(8), [], jaccard.small
    texts = [" ".join(draw.choices("abcdefghij", k=30)) for _ in range(40)]
    docs = [*enumerate(texts), (50, texts[0]), (51, texts[1]), (3, texts[2]), (4, texts[4]), (None, texts[5]), (None, texts[5]), (60, None)]
    monkeypatch.setattr(jaccard, "small", lambda df, n, *most: asked.append(n) or small(df, n, *most))
    found = jaccard.one_each(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80)
    # 3 stays by its first text, so both of its rows do; 4 repeats its text; rows without an id all stay
    want = [*enumerate(texts), (3, texts[2]), (None, texts[5]), (None, texts[5]), (60, None)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert asked[-1] == 2


def test_what_no_pair_needs_is_not_shuffled(spark, monkeypatch):
    table = spark.range(1000).select(F.col("id").alias("node"), F.lit("x").alias("line"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 5000)], "a long, b long")
    assert sorted(r.node for r in components.asked_for(table, pairs).collect()) == [1, 2, 3]
    monkeypatch.setattr(components, "BROADCAST_KEYS", 3)
    assert components.asked_for(table, pairs).count() == 1000


def test_candidates_lines_are_written_without_a_shuffle(spark, monkeypatch):
    draw, plans, write = random.Random(7), [], lines.written
    line = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=120))
    docs = [(i, f"{line}{i % 3}\n{line}") for i in range(20)]

    def seen(df):
        if df.columns == ["node", "line"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(lines, "written", seen)
    got = {r.dd_id: r.removed for r in lines.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [1]} | {i: [0, 1] for i in range(1, 20)}
    assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0]
