"""The ten operators against brute force, exact round trips and odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import components, decontaminate, linedup, mixing, neardup, outliers, pseudonyms, tagpaths, textkernel, tokenfiles, toxicity, warc
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd rows that every operator on documents must take: nulls, blanks, a long text, repeated rows, clashing columns.
ODD = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "längere Wörter — 世界 ퟿"), (6, "word " * 40000), (7, "a\u0000b <|endoftext|> it's 'tis")]


def documents(spark, rows=ODD):
    made = [(i, t, None if n % 3 else "en", f"s{n % 2}", n, "x", 1.0) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, id string, kept double")


def words(vocabulary, n, rng):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def union_find(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(None, 3), (5, 5)]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union_find(real, {x for p in real for x in p})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_decontaminate_equals_full_scoring(vocabulary):
    rng = random.Random(3)
    items = [(i, words(vocabulary, rng.randint(8, 90), rng) + ".", words(vocabulary, rng.randint(1, 6), rng) + ".") for i in range(40)] + [(40, "", ""), (41, "", "only answer words stand here"), (42, "…", "")]
    index = decontaminate.ItemIndex(items)
    for n in range(60):
        parts = [words(vocabulary, rng.randint(0, 300), rng)]
        for _ in range(n % 3):
            i, q, a = items[rng.randrange(40)]
            parts += [f"{q.upper()} {a}", words(vocabulary, rng.randint(0, 200), rng)]
        w = textkernel.folded_words([" ".join(parts)])
        terms = index.terms(w.hash)
        starts = range(0, max(1, len(terms) - decontaminate.STRIDE + decontaminate.STRIDE), decontaminate.STRIDE)
        full = {}
        for s in starts:
            inside = set(terms[s : s + decontaminate.PASSAGE].tolist()) - {-1}
            chosen = np.isin(index.post_term, list(inside))
            score = np.bincount(index.post_part[chosen], index.weight[chosen], len(index.item_of))
            for part in np.flatnonzero(score >= decontaminate.THRESHOLD):
                item = index.item_of[part]
                full[item] = max(full.get(item, 0), score[part])
        got = {item: score for item, score, *_ in index.leaks(w.hash, terms)}
        for item, score in got.items():
            assert score <= full[item] + 1e-9
        whole = " ".join(parts).lower()
        planted = {i for i, q, a in items[:40] if f"{q.lower()} {a}" in whole}
        assert planted <= {index.ids[item] for item in got}
        assert set(got) <= set(full)


def test_decontaminate_retrieves_all_passages(vocabulary):
    rng = random.Random(13)
    common = vocabulary[:12]
    items = [(i, " ".join([words(common, 9, rng), *rng.sample(vocabulary, 6)]) + ".", words(vocabulary, 3, rng) + ".") for i in range(60)]
    index = decontaminate.ItemIndex(items)
    assert not index.essential.all()
    for n in range(150):
        w = [f"x{k}" for k in range(rng.randint(0, 900))]
        for _ in range(rng.randint(0, 40) if w else 0):
            k, (_, q, a) = rng.randrange(len(w)), rng.choice(items)
            w[k:k] = rng.sample(common, 12) + ["y"] * rng.choice([0, 40, 60]) + f"{q} {a}".replace(".", "").split()[rng.randint(0, 12) :]
        terms = index.terms(textkernel.folded_words([" ".join(w)]).hash)
        full = {}
        for s in range(0, max(1, -(-len(terms) // decontaminate.STRIDE) - 1) * decontaminate.STRIDE, decontaminate.STRIDE):
            chosen = np.isin(index.post_term, list(set(terms[s : s + decontaminate.PASSAGE].tolist()) - {-1}))
            score = np.bincount(index.post_part[chosen], index.weight[chosen], len(index.item_of))
            full |= {(int(index.item_of[part]), s): score[part] for part in np.flatnonzero(score >= decontaminate.THRESHOLD)}
        got = {(item, s): score for item, at in index.retrieved(terms).items() for s, score in at.items()}
        assert got == pytest.approx(full)


def test_decontaminate_pivots_take_the_stride_before():
    index = decontaminate.ItemIndex([(i, f"a b c own{i} other{i}", "") for i in range(200)])
    index.needed = 0.9 * index.bound[index.terms(textkernel.folded_words(["own7"]).hash)].max()
    w = ["z"] * 320
    w[130], w[200] = "own7", "own9"
    terms = index.terms(textkernel.folded_words([" ".join(w)]).hash)
    assert index.pivots(np.array([130, 200]), terms, len(w)) == [64, 128, 192]


def test_decontaminate_verifies_later_passages(vocabulary):
    rng = random.Random(14)
    for size in (30, 150):  # of one part, and of several
        q, a = rng.sample(vocabulary, size), ["forty", "two"]
        index = decontaminate.ItemIndex([(5, " ".join(q) + ".", " ".join(a) + ".")])
        listed = sorted(q[:60] + a)
        fill = [f"x{k}" for k in range(1500)]
        for lists in (1, 4):
            text = " ".join([*(listed + fill) * lists, *q, *a, *fill])
            w = textkernel.folded_words([text])
            got = list(index.leaks(w.hash, index.terms(w.hash)))
            assert [x[0] for x in got] == [0] and got[0][2:4] == (1.0, 1.0) and got[0][4] >= 1400 * lists
        w = textkernel.folded_words([" ".join((listed + fill) * 5)])
        assert not list(index.leaks(w.hash, index.terms(w.hash)))


def test_decontaminate_rows(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    b, d = [tuple(r) for r in bench.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()]
    exact = {(i, j) for i, t in d for j, x in b if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    assert exact and exact <= got
    assert decontaminate.remove(docs, bench).count() == len({i for i, _ in d} - {i for i, _ in got})
    odd = documents(spark, [*ODD, (8, "before " + b[0][1] + " after")])
    assert [r["doc_id"] for r in decontaminate.find(odd, bench).collect()] == [8]
    assert decontaminate.find(odd.limit(0), bench).count() == 0 and decontaminate.find(odd, bench.limit(0)).count() == 0
    assert decontaminate.find(odd, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def overlap_brute(rows, items):
    """Leaks by plain scoring and sets of n-grams, a passage and a part at a time."""
    word = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    split = [(i, *(word(x) for x in decontaminate.split_item(t))) for i, t in items]
    parts = [(n, [w.tolist() for w in np.array_split(np.array(q + a, dtype=object), -(-len(q + a) // 64))] if q + a else []) for n, (_, q, a) in enumerate(split)]
    flat = [(n, p) for n, some in parts for p in some]
    df = Counter(w for _, p in flat for w in set(p))
    mean = np.mean([len(p) for _, p in flat])
    weigh = lambda w, p: np.log1p((len(flat) - df[w] + 0.5) / (df[w] + 0.5)) * p.count(w) * 2.2 / (p.count(w) + 1.2 * (0.25 + 0.75 * len(p) / mean))
    weights = [{w: weigh(w, p) for w in set(p)} for _, p in flat]
    grams = lambda x, k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    out = set()
    for doc, text in rows:
        w = word(text)
        for s in range(0, max(1, -(-len(w) // 64) - 1) * 64, 64):
            inside = set(w[s : s + 128])
            for (n, _), own in zip(flat, weights, strict=True):
                if sum(v for x, v in own.items() if x in inside) >= 0.6 * sum(own.values()):
                    _, q, a = split[n]
                    reach = max(128, len(q) + len(a))
                    near = w[max(0, s - reach) : s + 128 + reach]
                    share = lambda x: len(grams(x, min(3, len(x))) & grams(near, min(3, len(x)))) / len(grams(x, min(3, len(x)))) if x else 1.0  # noqa: B023, E731
                    if min(share(q), share(a)) >= 0.6 or share(q + a) >= 0.75:
                        out.add((doc, split[n][0]))
    return out


@pytest.mark.parametrize("shard", [16 << 20, 600])
def test_decontaminate_equals_brute_force(spark, vocabulary, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard)
    rng = random.Random(17)
    common = vocabulary[:15]
    items = [(i, words(common, rng.randint(2, 12), rng) + " " + words(vocabulary, rng.randint(1, 90), rng) + "? " + words(vocabulary, rng.randint(1, 5), rng) + ".") for i in range(25)] + [(25, None), (26, ""), (27, "One sentence only")]
    rows = []
    for n in range(80):
        parts = [words(vocabulary, rng.randint(0, 300), rng)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 2, 8, 20])):  # quoted more and more loosely
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            parts += [" ".join(w).upper(), words(common, rng.randint(0, 150), rng)]
        rows.append((n, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = overlap_brute(rows, items)
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find(documents(spark, rows), bench).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_decontaminate_without_spaces(spark):
    bench = spark.createDataFrame([(1, "下列哪一座山是世界上最高的山峰？珠穆朗玛峰。"), (2, "Какая река самая длинная в Европе? Волга.")], "item_id long, text string")
    rows = [(1, "前面的话。下列哪一座山是世界上最高的山峰？珠穆朗玛峰。后面的话"), (2, "世界上有很多山。"), (3, "Вопрос: какая река самая длинная в европе — «Волга»!"), (4, "下列哪一座山，是世界上最高的山峰 😀 珠穆朗玛峰")]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(documents(spark, rows), bench).collect()} == {(1, 1), (3, 2), (4, 1)}


def test_filters_judge_rows_not_ids(spark):
    leak = "What is the name of the tallest mountain in the world? Mount Everest."
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    docs = documents(spark, [(None, leak), (None, "clean"), (7, leak), (7, "also clean"), (8, None)])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.remove(docs, bench).collect()) == [(0, "clean"), (7, "also clean"), (8, "")]
    rows = [(i, " ".join(["plain words here"] * 5 + (["blorgish vexnord kwaddle"] * 2 if i % 3 == 0 else []))) for i in range(300)]
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    odd = documents(spark, [*rows, (None, rows[0][1]), (None, "plain words here"), (500, rows[0][1]), (500, "plain words here")])
    kept = toxicity.reject(odd, marked)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in range(300) if i % 3] + [(False, 500), (True, 0)]


# 2


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["the", "an", "er", "tion", "re", "in", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    bad = ["blorgish", "vexnord", "kwaddle", "zumptic"]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marked)).collect()
    assert {r["held_out"] for r in got} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    odd = toxicity.score(documents(spark), toxicity.fit(docs, marked)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd)
    assert toxicity.reject(documents(spark), marked.limit(0)).count() == len(ODD)
    alone = toxicity.fit(docs, marked.where("toxic = 1"))
    assert {r["score"] for r in toxicity.score(documents(spark), alone).collect()} == {1.0}


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(15)
    plain = ["".join(rng.choice(["the", "an", "er", "tion", "re", "in", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        w = words(plain, 1800, rng)
        toxic = i % 3 == 0
        if toxic:  # after character 8000, or after byte 40 of a run without spaces
            w += " " + " ".join(["blorgish"] * 3 if i % 2 else [w[:200].replace(" ", "") + "vexnordzum"] * 3)
        assert len(w) > 8200
        rows.append((i, w))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"blorgish" in model.toxic and b"vexnordzum" in model.toxic
    got = toxicity.score(docs, model).collect()
    truth = dict(labels)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97


# 3


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(pairs, sets).items()}


def copies(vocabulary, rng):
    rows = []
    for _ in range(25):
        base = words(vocabulary, rng.randint(3, 150), rng).split(" ")
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) if rng.random() < 0.7 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize(("node", "block"), [(256, 2048), (3, 2048), (3, 3)])
def test_near_duplicates_equal_brute_force(spark, vocabulary, node, block, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = copies(vocabulary, random.Random(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.find(documents(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in near_brute(rows).items()}


@pytest.mark.parametrize("node", [256, 8])
def test_near_duplicates_recall(spark, vocabulary, node, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "BLOCK", max(node, 64))
    rng = random.Random(19)
    rows, linked = [], 0
    for _ in range(500):
        w = words(vocabulary, 120, rng).split(" ")
        v = list(w)
        v[rng.randrange(5, 115)] = "changed"  # five of 116 shingles: a similarity of 0.92
        if rng.random() < 0.5:
            v[rng.randrange(0, 3)] = "other"  # and up to three more: 0.87 or so
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
        linked += 100 * len(shingles(rows[-1][1]) & shingles(rows[-2][1])) >= 85 * len(shingles(rows[-1][1]) | shingles(rows[-2][1]))
    got = neardup.find(documents(spark, rows)).where("not kept").count()
    print(f"recall {got / linked:.4f} of {linked} links, nodes of {node}")
    assert linked > 400 and got >= 0.99 * linked


def test_near_duplicates_odd_input(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.find(documents(spark)).collect()]
    assert len(got) == len(ODD) and (None, 1, None, True) in got and (1, 0, 1, True) in got and (2, 0, 2, True) in got and got.count((4, 1, 4, True)) == 2
    kept = neardup.keep_one(documents(spark, [*ODD, (9, "one"), (10, "ONE ")]))
    assert kept.columns == documents(spark).columns and 9 not in {r["doc_id"] for r in kept.collect()} and kept.count() == len(ODD) - 1  # of the equal rows 4, one
    plain = "a plain text of some words that stands in several rows"
    rows = [(None, plain), (None, plain), (3, plain), (3, "quite another text that shares the id of its neighbour"), (5, plain + " "), (None, "only this row has this text and no id"), (None, ""), (None, "")]
    kept = neardup.keep_one(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(3, plain), (3, rows[3][1]), (0, rows[5][1]), (0, ""), (0, "")])
    assert neardup.find(documents(spark).limit(0)).count() == 0
    two = neardup.find(documents(spark, [(1, "a b c d e f g"), (1, "other words stand in this row"), (2, "other words stand in this row")])).collect()
    assert len(two) == 3


# 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>one<p>two <b>bold</b>x", "one\ntwo boldx"),
        ("<body><nav><a>Menu, here.</a></nav><article><h1>Title</h1><p>Text, more\n of it.<br>Next &eacute;.</p><ul><li>a<li>b</ul></article><footer>f, g, h.</footer>", "Title\nText, more of it. Next é.\na\nb"),
        ('<div id="header">Site</div><div class="main"><h1>T</h1><p>First paragraph, with text. More of it.</p><p>x</p><div class="comments"><p>Nice, one. Really.</p></div></div><div class="sidebar">s</div>', "T\nFirst paragraph, with text. More of it.\nx"),
        ("<main><header><h1>T</h1><span>by me</span></header><p>a b, c.</p><form>q<input></form><aside>x</aside><script>if (a</b) {}</script><style>p{}</style></main>", "T\na b, c."),
        ("<article><p>a, b.</p><!-- <p>no</p> --><div class='ad'>buy</div><p hidden>h</p><section class='comments'><article><p>me, too.</p></article></section><p>c</p>", "a, b.\nc"),
        ("<article><table><tr><td>x, y<td>z<tr><td>w</table><p>&lt;b&gt;</article>", "x, y\nz\nw\n<b>"),
        ("<article><p>open <!-- never closed", "open"), ("<script>only", ""), ('<p title="a>b">t</p>', "t"),
    ],
)
def test_main_text(page, text):
    assert tagpaths.main_text(page) == text


@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><div id='c'>{}</div></body>", "<body><div>{}<div>x</div></div></body>", "<body><div><article>{}</article></div></body>"])
@pytest.mark.parametrize(("first", "second"), [(13, 7), (7, 13), (19, 1), (10, 10)])
def test_main_text_of_a_split_body(around, first, second):
    line = "Sentence {} stands here, with words. And a few more of them."
    lines = [line.format(n) for n in range(first + second)]
    halves = ["".join(f"<p>{x}</p>" for x in some) for some in (lines[:first], lines[first:])]
    for tag in ("div", "section", "article"):
        got = tagpaths.main_text(around.format("<nav>a, b.</nav>" + "".join(f"<{tag}>{h}</{tag}>" for h in halves))).split("\n")
        assert [x for x in got if x != "x"] == lines


LINE = "A sentence of the article, with some words in it. And one more."


@pytest.mark.parametrize("around", ['<div class="page sidebar-right">{}</div>', '<div class="ad-free">{}</div>', '<article class="social-science">{}</article>', '<div id="menu-page"><section class="no-sidebar">{}</section></div>'])
def test_main_text_under_misleading_names(around):
    got = tagpaths.main_text(f"<body><div class='sidebar-right'>Links, more links.</div>{around.format(f'<p>{LINE}</p>' * 5)}<div class='comments'>{f'<p>{LINE}</p>' * 30}</div></body>")
    assert got == "\n".join([LINE] * 5)


def test_main_text_of_odd_markup():
    page = f"<article><header><h1>T</h1><p>{LINE} {LINE}</p><span>by me</span></header><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, then <img src=x> <script>no()</script>so.</p><p>{LINE}</p><hr><p>Short</p><ul><li>a<li>b</ul><div><a>Share</a> <a>Print</a></div></article>"
    assert tagpaths.main_text(page) == f"T\n{LINE} {LINE}\nIf x=2, then so.\n{LINE}\nShort\na\nb"


def test_main_text_paths_decide():
    links = "".join(f"<a href=x>Go{n}</a><br>" for n in range(5))
    page = f"<body><div class=zig>{links}</div><div class=zag><h2>T</h2>{f'<p>{LINE}</p>' * 8}<div>cap</div><p>{LINE}</p><p>end</p></div><div class=zog>{links}</div></body>"
    assert tagpaths.main_text(page) == "\n".join(["T", *[LINE] * 8, "cap", LINE, "end"])


def test_main_text_grows_with_the_page():
    import time

    took = []
    for n in (4000, 16000):
        start = time.perf_counter()
        for page in ("<div>" * n + "x", "<div>x" * n, ("<b>" * 4 + "<h1>") * n, "<div>" * n + "</p></td>" * n, "<a " * n, "<p>" * n + "<td>" * n, "<i>" * n + "<tr><td>" * n):
            tagpaths.main_text(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 1


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in tagpaths.extract(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!/?p|/?h1)[^>]+>", " ", b))).strip() for b in re.split(r"</?p>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]
    odd = spark.createDataFrame([(None, None, None), (1, "u", "<p>" * 2000 + "deep"), (1, "u", "<p>" * 2000 + "deep"), (2, "", "<p>word</p>" * 50_000)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in tagpaths.extract(odd).collect()) == ["", "deep", "deep", "\n".join(["word"] * 50_000)]
    assert tagpaths.extract(odd.limit(0)).count() == 0


# 5


def test_counts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab# |\n\t é") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [t for _, t in ODD]
    for t, got in zip(texts, outliers.counts(texts), strict=True):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)]
        assert got[:6].tolist() == want, t


def test_outliers(spark, vocabulary):
    rng = random.Random(7)
    rows = [(i, words(vocabulary, rng.randint(60, 200), rng)) for i in range(400)] + [(1000 + i, words(vocabulary, 80, rng).replace(" ", "$$$ ")) for i in range(12)] + [(2000, words(vocabulary, 49, rng)), (2001, "same words again " * 30), (3000, None), (3001, ""), (3002, " \n")]
    got = {r["doc_id"]: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert sum(got[i]["kept"] for i in range(400)) >= 398 and not any(got[1000 + i]["kept"] for i in range(12))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and got[3001]["base_failed"] and not got[3000]["kept"]
    again = {r["doc_id"]: r["distance"] for r in outliers.judge(documents(spark, rows).orderBy(F.rand())).collect()}
    assert again == {i: r["distance"] for i, r in got.items()}
    assert outliers.judge(documents(spark)).count() == len(ODD) and outliers.judge(documents(spark).limit(0)).count() == 0


def mcd_in_memory(x, cover, starts):
    """Centre and scatter of the least determinant, by concentration steps on a plain array."""
    best = None
    for centre, scatter in starts:
        last = np.inf
        for _ in range(100):
            gap = x - centre
            near = np.argsort(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(outliers._floored(scatter)), gap), kind="stable")[: int(np.ceil(cover * len(x)))]
            centre, scatter = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
            now = np.linalg.slogdet(outliers._floored(scatter))[1]
            if now >= last - 1e-9:
                break
            last = now
        best = min(best or (np.inf,), (now, centre, scatter), key=lambda b: b[0])
    return best


def test_mcd_equals_one_in_memory(spark):
    rng = np.random.default_rng(8)
    d = outliers.D
    clouds = {}
    for n, (g, share) in enumerate((("clean", 0.0), ("near", 0.2), ("far", 0.2), ("wide", 0.15))):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        clean = 2 + rng.normal(0, 1, (700, d)) @ np.diag([0.6, 0.5, 0.4, 0.4, 0.3, 0.3]) @ turn
        k = int(700 * share)
        odd = rng.normal(5 if g == "near" else 9, 0.1, (k, d)) if g != "wide" else rng.normal(2, 6, (k, d))
        clouds[g] = np.round(np.concatenate((clean, odd)) * outliers.GRID) / outliers.GRID
    rows = [(g, *(int(v) for v in r)) for g, x in clouds.items() for r in np.round(x * outliers.GRID)]
    made = outliers.estimate(spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} long" for i in range(d))).repartition(7))
    for r in made.collect():
        x = clouds[r["g"]]
        middle = np.median(x, axis=0)
        spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
        unit = (x - middle) / spread
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        _, centre, scatter = mcd_in_memory(x, outliers.COVER, [(middle, np.diag(spread**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (middle, unit.T @ unit / len(x) * d * np.outer(spread, spread))])
        got = np.array([r[f"c{i}"] for i in range(d)])
        shape = outliers._square(r.asDict())
        assert np.abs(got - centre).max() < 0.05, r["g"]
        assert np.abs(shape / np.trace(shape) - scatter / np.trace(scatter)).max() < 0.03, r["g"]
        assert np.abs(got - 2).max() < 0.15  # whatever is mixed in


def test_groups_of_a_few_rows(spark, vocabulary):
    rng = random.Random(20)
    rows = [(i, words(vocabulary, 60, rng) + " !?" * (i % 7) + "\n#" * (i % 5), "en", f"s{min(i // 2, i % 11)}") for i in range(60)]
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 60 and all(r["distance"] is not None for r in got)


def test_small_sources_are_judged_alike(spark, vocabulary):
    """A source of its own kind keeps about as large a share of its rows, however many there are."""
    rng = random.Random(18)
    plain = [(i, words(vocabulary, rng.randint(80, 200), rng), "en", "main") for i in range(500)]
    for n in (8, 30, 59, 60, 90):
        own = [(1000 + i, " ".join(rng.choice(vocabulary).upper() + rng.choice([";", "()", ""]) for _ in range(rng.randint(80, 200))), "en", "code") for i in range(n)]
        got = outliers.judge(spark.createDataFrame(plain + own, "doc_id long, text string, lang string, source string")).collect()
        assert sum(r["kept"] for r in got if r["doc_id"] >= 1000) >= 0.9 * n and sum(r["kept"] for r in got if r["doc_id"] < 1000) >= 490, n


# 6


def test_pseudonyms_round_trip():
    key, other = b"k", b"other"
    text = "card 4207051279108084 and 4111 1111 1111 1111, call +1 (543) 555-9258 or 212-555-1234 or +44 20 7946 0958; 2020-03-04, 25/12/1999, 12/25/1999, 5 March 2021, March 5, 2021; 29.217.126.147; hsr.29@mail5.example.com; DE89 3704 0044 0532 0130 00; 123-45-6789"
    new, spans = pseudonyms.rewrite(text, pseudonyms.permuter(key))
    assert Counter(k for *_, k in spans) == {"card": 2, "phone": 3, "date": 5, "ip": 1, "email": 1, "iban": 1, "ssn": 1}
    assert pseudonyms.reveal(new, key) == text and pseudonyms.rewrite(text, pseudonyms.permuter(other))[0] != new
    assert all(text[a:b] not in new for a, b, _ in spans)
    again, _ = pseudonyms.rewrite(new, pseudonyms.permuter(key))
    assert len(pseudonyms.rewrite(new, pseudonyms.permuter(key))[1]) == len(spans) and again != new
    plain = "order 1234567890123456, version 1.2.3, 999.1.1.1, 2020-13-45, 000-12-3456, a@b, 3/4, 10%"
    assert pseudonyms.rewrite(plain, pseudonyms.permuter(key)) == (plain, [])


@pytest.mark.parametrize(("value", "after"), [("4111 1111 1111 1111", " 12/27"), ("4111111111111111", " 123"), ("4111-1111-1111-1111", "-123"), ("ES91 2100 0418 4502 0005 1332", " EUR"), ("DE89 3704 0044 0532 0130 00", " USD"), ("4207051279108084", " 7 8")])
def test_pseudonyms_of_numbers_before_other_groups(value, after):
    for k in range(60):  # by chance, some pseudonyms would be valid together with what follows
        text, key = f"paid {value}{after}, 12 {value}.", b"key%d" % k
        new, spans = pseudonyms.rewrite(text, pseudonyms.permuter(key))
        assert [text[a:b] for a, b, _ in spans] == [value, value] and value not in new and f"{after}, 12 " in new
        assert pseudonyms.reveal(new, key) == text


def test_pseudonyms_link_dates_of_all_layouts():
    permute = pseudonyms.permuter(b"k")
    for y, m, d in ((2020, 12, 25), (2020, 5, 4), (1999, 1, 31), (2024, 2, 29), (1900, 1, 1), (2099, 12, 31)):
        name = pseudonyms.MONTHS[m - 1]
        layouts = [f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d} {name} {y}", f"{name} {d}, {y}", f"{d}.{m}.{y}", f"{y}/{m}/{d}"] + ([f"{m:02d}/{d:02d}/{y}", f"{m}/{d}/{y}"] if d > 12 else [])
        seen = set()
        for n, x in enumerate(layouts):
            new, spans = pseudonyms.rewrite(f"on {x}.", permute)
            assert [s[2] for s in spans] == ["date"]
            a = re.findall(r"[0-9]+|[A-Z][a-z]+", new[3:])
            order = {0: (0, 1, 2), 1: (2, 1, 0), 2: (2, 1, 0), 3: (2, 0, 1), 4: (2, 1, 0), 5: (0, 1, 2), 6: (2, 0, 1), 7: (2, 0, 1)}[n]
            seen.add(tuple(pseudonyms.MONTHS.index(a[i]) + 1 if a[i].isalpha() else int(a[i]) for i in order))
            if n not in (4, 5, 7):
                assert pseudonyms.reveal(new, b"k") == f"on {x}."
        assert len(seen) == 1, (layouts, seen)


def test_pseudonyms_of_plain_and_long_phones():
    for text, value in (("call 5551234567 now", None), ("call 2125551234 now", "2125551234"), ("on +44 20 7946 0958 2020 it", "+44 20 7946 0958"), ("id 1690000000 x", None)):
        new, spans = pseudonyms.rewrite(text, pseudonyms.permuter(b"k"))
        assert [text[a:b] for a, b, _ in spans] == ([value] if value else []) and pseudonyms.reveal(new, b"k") == text


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"z")
    for n in (1, 2, 3, 10, 97, 1000):
        images = [f.permute("t", i, n) for i in range(n)]
        assert sorted(images) == list(range(n)) and [f.permute("t", i, n, True) for i in images] == list(range(n))


def test_pseudonyms_rows(spark):
    rows = pseudonyms.pseudonymise(documents(spark, [*ODD, (8, "call 212-555-1234"), (9, "212-555-1234 again")]), b"k").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 2 and by[1]["text"] is None and by[2]["text"] == "" and by[6]["n_replaced"] == 0
    assert by[8]["text"].split()[-1] == by[9]["text"].split()[0] != "212-555-1234"


# 7


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(9)
    rows = [(1000 - i, "".join(rng.choice(" '\n\tabstdmrevl'sé12.,!\u0085²À世") for _ in range(rng.randint(0, 40)))) for i in range(500)] + ODD
    made = tokenfiles.write(documents(spark, rows).repartition(5), path, 2)
    got = made.read().orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x))
    start = 0
    texts = {i: x for i, x in rows}
    for r in got:
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.write(documents(spark).limit(0), path, 2).read().count() == 0


def test_token_files_of_several_pieces(spark, monkeypatch):
    import public_tokenizers
    from pyarrow import fs as pafs

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "some words " * (i % 50)) for i in range(400)]
    want = [tuple(r)[:4] for r in tokenfiles.write(documents(spark, rows), path, 2).read().orderBy("start").collect()]
    monkeypatch.setattr(tokenfiles, "PART_TOKENS", 500)
    monkeypatch.setattr(tokenfiles, "READ_TOKENS", 100)
    monkeypatch.setattr(tokenfiles, "BATCH_CHARS", 1000)
    made = tokenfiles.write(documents(spark, rows).repartition(3), path, 2)
    assert made.parts.count() > 20
    assert [tuple(r)[:4] for r in made.read().orderBy("start").collect()] == want
    files, root = tokenfiles.open_fs(made.folder)
    part = made.manifest.orderBy("base").first()
    stem = tokenfiles._stem(root, part["part"], part["piece"])
    far = pafs.SubTreeFileSystem("/", files)  # a store that is not local
    read = lambda store: [b.to_pylist() for b in tokenfiles._read_part(store, stem, made.dtype, 0, 0, 0)]
    assert read(far) == read(files)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = tokenfiles.Encoder(path), Tokenizer.from_file(path)
    plain = textkernel.Slices.hash
    monkeypatch.setattr(tokenfiles.Slices, "hash", lambda self, a, b: plain(self, a, b) % np.uint64(3) if self.family == 0 else plain(self, a, b))
    text = "many different words that all share a few hashes"
    assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_tokenizer_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    for x, y in zip(e.encode(["Some Words", "", None]), ["Some Words", "", ""], strict=True):
        assert x.tolist() == t.encode(y, add_special_tokens=False).ids


# 8


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, n):
    out = []
    for _ in range(n):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(20, 40)))
        b = a
        for _ in range(rng.randint(0, 4)):
            k, kind = rng.randint(0, len(b)), rng.randint(0, 2)
            b = b[:k] + (rng.choice("abcd") if kind < 2 else "") + b[k + (kind > 0) :]
        out.append((a, b))
    return [(a, b) for a, b in out if len(b) >= 20]


def test_banded_distance():
    rng = random.Random(10)
    pairs = edited(rng, 1500)
    pairs += [("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(500)]
    for k in (1, 2, 3):
        assert linedup.distances(pairs, k).tolist() == [min(edit_distance(a, b), k + 1) for a, b in pairs]


@pytest.mark.parametrize("cell", [1024, 6])
def test_line_dedup_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(linedup, "CELL", cell)
    rng = random.Random(11)
    lines = [x for p in edited(rng, 200) for x in p] + ["short", "short", "", " ", "a short line.", "a short lime.", "a short lime!"]
    for _ in range(150):  # of 0 to 40 characters
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
        k = rng.randint(0, len(a))
        lines += [a, a[:k] + rng.choice("abc") + a[k + rng.randint(0, 1) :], a[:k] + a[k + 2 :]]
    lines += [f"posted by user {a}{b} on monday" for a in "0123456789" for b in "012345678"]  # a group of which all are linked
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[8 * i : 8 * i + 8])) for i in range(len(lines) // 8 + 1)]
    got = linedup.find(documents(spark, rows)).collect()
    text = {(i, n): x for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()}
    assert {(r["doc_id"], r["line_no"]) for r in got} == set(text)
    known = sorted(set(text.values()))
    allowed = lambda a, b: min(2, min(len(a), len(b)) // 10)
    pairs = [(a, b) for n, a in enumerate(known) for b in known[n + 1 :] if allowed(a, b) >= max(1, abs(len(a) - len(b))) and edit_distance(a, b) <= allowed(a, b)]
    degree, comp = Counter(x for p in pairs for x in p), union_find(pairs, known)
    first = {}
    for place in sorted(text):
        first.setdefault(comp[text[place]], place)
    for r in got:
        place = (r["doc_id"], r["line_no"])
        assert (r["n_links"], r["class_doc"], r["class_line"]) == (degree[text[place]], *first[comp[text[place]]])
        assert r["kept"] == (first[comp[text[place]]] == place)


def test_line_dedup_odd_input(spark):
    got = linedup.find(documents(spark)).collect()
    assert sum(r["doc_id"] == 4 for r in got) == 2 and all(r["kept"] for r in got)
    out = linedup.drop_repeats(documents(spark, [(1, "a line of some length here\nshort\n\nshort"), (2, "a line of some length hexe\nb"), (3, None), (4, "one of two rows"), (4, "one of two rows")]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a line of some length here\nshort"), (2, "b"), (3, ""), (4, "one of two rows"), (4, "one of two rows")]
    assert out.columns == documents(spark).columns
    assert linedup.find(documents(spark).limit(0)).count() == 0
    long = "x y " * 40_000
    pair = linedup.find(documents(spark, [(1, long + "end"), (2, long + "and"), (3, "y" + long)])).collect()
    assert {(r["doc_id"], r["n_links"], r["class_doc"], r["kept"]) for r in pair} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


# 9


@pytest.mark.parametrize("local", [1 << 16, 0])
def test_raking_meets_all_marginals(spark, local, monkeypatch):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    rng = random.Random(12)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice("abc"), rng.choice(["en", "de"]), rng.choice("xyz")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.2, "y": 0.2, "z": 0.6}}
    targets = {d: spark.createDataFrame(list(v.items()), f"{d} string, target double") for d, v in wanted.items()}
    got = mixing.sample(docs, targets, 0.3, topic_col="topic").toPandas()
    spent = got.tokens * got.rate
    for d, shares in wanted.items():
        part = spent.groupby(got[d]).sum() / spent.sum()
        assert all(abs(part[k] - v) < 0.002 for k, v in shares.items())
    assert abs(spent.sum() / got.tokens.sum() - 0.3) < 0.001 and abs(got.tokens[got.kept].sum() / got.tokens.sum() - 0.3) < 0.03
    # the same by a plain loop over the cells
    cells = got.groupby(["source", "lang", "topic"]).tokens.sum().astype(float)
    fit = cells.copy()
    for _ in range(200):
        for d, shares in wanted.items():
            now = fit.groupby(level=d).transform("sum")
            fit = fit * fit.index.get_level_values(d).map(shares).to_numpy() * cells.sum() / now
    rate = fit / cells
    rate = rate / (rate * cells).sum() * 0.3 * cells.sum()
    assert rate.max() < 1
    for r in got.drop_duplicates(["source", "lang", "topic"]).itertuples():
        assert abs(rate[r.source, r.lang, r.topic] - r.rate) < 1e-3


@pytest.mark.parametrize("local", [1 << 16, 0])
def test_bounded_raking(spark, local, monkeypatch):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    rng = random.Random(16)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice("aaab"), rng.choice(["en", "en", "de"]), rng.choice("xyz")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    # nearly all of b is wanted, so that its cells stand at 1 while the marginals of the rest still hold
    targets = {"source": spark.createDataFrame([("a", 0.6), ("b", 0.4)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "lang string, target double")}
    got = mixing.sample(docs, targets, 0.6, topic_col="topic").toPandas()
    spent = got.tokens * got.rate
    assert got.rate.max() == 1 and abs(spent.sum() / got.tokens.sum() - 0.6) < 1e-3
    assert abs(spent[got.lang == "de"].sum() / spent.sum() - 0.4) < 2e-3
    own = got.groupby("topic").tokens.sum() / got.tokens.sum()
    for t in "xyz":
        assert abs(spent[got.topic == t].sum() / spent.sum() - own[t]) < 2e-3


def test_mixing_says_what_cannot_be_met(spark):
    rows = [(i, "word " * 10, "a" if i % 10 else None, "en", "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": spark.createDataFrame([(None, 0.5), ("a", 0.5)], "source string, target double")}
    with pytest.warns(UserWarning, match="source None: 500 of 1250 wanted, 500 there are"):
        got = mixing.sample(docs, targets, 0.5, topic_col="topic").toPandas()
    spent = got.tokens * got.rate
    assert got.rate[got.source.isna()].min() == 1 and abs(spent.sum() / got.tokens.sum() - 0.5) < 1e-6


def test_mix_rows(spark):
    docs = documents(spark, ODD + [(i, "some words here") for i in range(100, 400)])
    kept = mixing.mix(docs)
    again = {r["doc_id"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == again
    assert mixing.sample(docs).count() == docs.count() and mixing.sample(docs.limit(0)).count() == 0


# 10


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://x/a", "<html lang=en><head><title>T &amp; u</title></head><body><p>One</p><a href='/b'>two</a><script>no</script></body></html>"), (2, None, None), (3, "http://x/c", "")], "page_id long, url string, html string")
    sources = {r["id"]: warc.read_record(bytes(r["record"])) for r in warc.responses(pages).collect()}
    rows = warc.build(warc.responses(pages)).collect()
    assert len(rows) == 6
    for r in rows:
        headers, block = sources[r["id"]]
        assert r["refers_to"] == dict(headers)["WARC-Record-ID"] and r["payload_digest"] == dict(headers)["WARC-Payload-Digest"]
        own, data = warc.read_record(warc.record_bytes(r["headers"], r["block"]))
        assert data == bytes(r["block"]) and warc.digest(data) == r["block_digest"] and dict(own)["WARC-Record-ID"] == r["record_id"]
        partner = next(x for x in rows if x["id"] == r["id"] and x["warc_type"] != r["warc_type"])
        assert dict(own)["WARC-Concurrent-To"] == partner["record_id"]
    one = {r["warc_type"]: bytes(r["block"]).decode() for r in rows if r["id"] == 1}
    assert one["conversion"] == "One\ntwo" and '"Title": "T & u"' in one["metadata"] and '"/b"' in one["metadata"]
    import gzip

    response = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")
    request = warc.write_record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")
    assert [x[4] for x in warc.derive(gzip.compress(response))][1] == b"abcde" and warc.derive(request) == []
    assert list(warc.read_records(gzip.compress(response) + gzip.compress(request))) == [response[:-4], request[:-4]]
    odd = spark.createDataFrame([(1, None), (2, b"junk"), (3, response[:40])], "id long, record binary")
    got = warc.build(odd).collect()
    assert len(got) == 3 and all(r["warc_type"] == "metadata" and b"error" in bytes(r["block"]) and r["refers_to"] is None for r in got)
    assert warc.build(odd.limit(0)).count() == 0


def test_warc_pages_and_codings():
    import gzip
    import json

    def made(body, *http, payload=""):
        block = "".join(f"{x}\r\n" for x in ["HTTP/1.1 200 OK", "Content-Type: text/html", *http]).encode() + b"\r\n" + body
        out = warc.derive(warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>"), ("WARC-Payload-Digest", payload)], block))
        return [x[0] for x in out], json.loads(out[0][4]), out[-1][4].decode()

    page = b"""<p title="a > b">x</p><head-line>y</head-line> z<!-- <a href=no> --><script src='s.js'>"<a href=no>"</script><a href = "/b&amp;c">w</a>"""
    kinds, about, text = made(page)
    assert kinds == ["metadata", "conversion"] and text == "x\ny zw" and [x["url"] for x in about["HTML"]["Links"]] == ["s.js", "/b&c"]
    packed = zlib.compress(page)
    for coding, body in (("gzip", gzip.compress(page)), ("deflate", packed), ("deflate", packed[2:-4]), ("gzip, deflate", zlib.compress(gzip.compress(page)))):
        kinds, about, text = made(body, f"Content-Encoding: {coding}", payload=warc.digest(body))
        assert text == "x\ny zw" and about["Envelope"]["Payload"]["Digest-Agrees"]
    kinds, about, _ = made(b"\x1b\x00", "Content-Encoding: br")
    assert kinds == ["metadata"] and "br" in about["Error"] and about["Envelope"]["Payload"]["Digest-Agrees"] is None
    kinds, about, _ = made(b"junk", "Content-Encoding: deflate")
    assert kinds == ["metadata"] and "deflate" in about["Error"]
    chunked = b"4\r\n<p>a\r\n1;x=y\r\nb\r\n0\r\n\r\n"
    for stated, same in ((warc.digest(b"<p>ab"), True), (warc.digest(chunked), True), (warc.digest(b"no"), False), ("", None), ("sha256:" + __import__("hashlib").sha256(b"<p>ab").hexdigest(), True)):
        kinds, about, text = made(chunked, "Transfer-Encoding: chunked", payload=stated)
        assert text == "ab" and about["Envelope"]["Payload"]["Digest-Agrees"] is same


def test_warc_files_and_odd_rows(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "u", "<p>a" * 30000), (1, "u", "<p>a" * 30000), (2, None, "<a " * 16000)], "page_id long, url string, html string").withColumn("record", F.lit(b"x")).withColumn("id", F.lit("y"))
    records = [bytes(r["record"]) for r in warc.responses(pages).orderBy("id").collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records) + b"\r\n")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(records[0])[:40])
    (tmp_path / "e.warc").write_bytes(b"")
    got = warc.read_files(spark, f"{tmp_path}/*").withColumn("headers", F.lit(1))
    by = {}
    for r in got.collect():
        by.setdefault(r["path"][-9:].split("/")[-1], []).append(bytes(r["record"]).rstrip(b"\r\n"))
    want = [r.rstrip(b"\r\n") for r in records]
    assert by["a.warc.gz"] == by["b.warc"] == by["c.warc.gz"] == want and "e.warc" not in by
    built = warc.build(got.where("path not like '%d.warc.gz'")).collect()
    assert len(built) == 18 and len({(r["record_id"], bytes(r["block"])) for r in built}) == 4
    long = next(r for r in built if r["warc_type"] == "conversion" and r["target_uri"] == "u")
    assert bytes(long["block"]) == b"\n".join([b"a"] * 30000)
