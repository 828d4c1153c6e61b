"""Jaccard join, top-k, extraction, toxicity, pipeline."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from planshift.llm.components import components  # noqa: E402
from planshift.llm.extraction import extracted, main_text, minimum_cut  # noqa: E402
from planshift.llm.jaccard import jaccard_classes, least_matches, without_near_copies  # noqa: E402
from planshift.llm.topk import accumulated, top_k  # noqa: E402
from planshift.llm.toxicity import (  # noqa: E402
    LETTERS, SWAPS, features_of, fit_toxicity, held_out, scored, sentence_swaps, without_toxic,
)


def brute_links(data):
    sets = []
    for d in data:
        w = (d[1] or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, links = list(range(len(data))), [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    smallest = {x: min(data[i][0] for i in range(len(data)) if label[i] == x) for x in set(label)}
    return sorted((data[i][0], smallest[label[i]], links[i]) for i in range(len(data)))


def test_jaccard_equals_brute_force(spark):
    data = [(i, t, None, None, 0, *["x"] * 6) for i, t in enumerate(
        d[1] if d[1] is None or " " not in d[1] else "plain words instead of these" for d in corpus.rows())]
    draw, base = random.Random(9), corpus.prose(77, 150).split(" ")
    for i in range(150):  # a group of near copies around the threshold, larger than a block
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(150)] = draw.choice(corpus.WORDS)
        data.append((1000 + i, " ".join(words), None, None, 0, *["x"] * 6))
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(corpus.frame(spark, data)).collect())
    assert got == brute_links(data)
    assert jaccard_classes(corpus.empty(spark)).count() == 0
    kept = {r["doc_id"] for r in without_near_copies(corpus.frame(spark, data)).select("doc_id").collect()}
    assert kept == {c for _, c, _ in got}


def test_near_copies_go_by_row_not_by_key(spark):
    texts = [corpus.prose(k, 60) for k in range(6)]
    near = [f"{t} tail" for t in texts]
    data = [
        (1, texts[0]), (1, texts[0]), (1, texts[0]),  # repeats of one row: one stays
        (2, texts[1]), (3, near[1]), (3, texts[2]),  # one of two texts of an id is a near copy: the other one stays
        (None, texts[3]), (None, near[3]), (9, texts[3]),  # near copies without id: one stays
        (None, texts[4]), (None, texts[5]),  # no copies
        (5, None), (5, None), (6, " "), (None, ""),  # no words: all stay
    ]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = Counter(tuple(r) for r in without_near_copies(df.repartition(4)).collect())
    assert sum(kept[None, t] for t in (texts[3], near[3])) == 1
    kept -= Counter([(None, texts[3]), (None, near[3])])
    assert kept == Counter([
        (1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[4]), (None, texts[5]), (5, None), (5, None), (6, " "), (None, ""),
    ])
    assert without_near_copies(df.limit(0)).count() == 0


def test_groups_are_cut_by_bytes_too(spark, monkeypatch):
    base = corpus.prose(78, 200).split(" ")
    data = [(i, " ".join([*base[:i * 7], f"own{i}", *base[i * 7 + 1:]]), None, None, 0, *["x"] * 6) for i in range(20)]
    monkeypatch.setattr("planshift.llm.jaccard.BLOCK_BYTES", 2_000)  # about one text a block
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(corpus.frame(spark, data)).collect())
    assert got == brute_links(data)


def test_pruning_keeps_what_may_reach_the_threshold():
    for n, m in least_matches(0.8, 1e-9):
        assert 0 <= m < 0.8 * n


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    vectors = [(i, draw.normal(size=8).round(2).tolist(), i) for i in range(300)]
    vectors += [(i, vectors[7][1], 0) for i in range(300, 330)]  # many equal vectors: ties
    vectors += [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (450, [], 0), (None, [1.0] * 8, 0), (404, [9.0], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    whole = {
        i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v, _ in vectors
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == sorted(want)
    assert top_k(df.limit(0)).count() == 0
    assert accumulated(np.array([[2.0**40]]), np.array([[2.0**40], [-2.0**40]])).tolist() == [[2**63 - 1, -(2**63)]]


def brute_cut(odds, edges):
    best = None
    for mask in range(1 << len(odds)):
        side = [mask >> i & 1 for i in range(len(odds))]
        cost = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_is_minimal():
    draw = random.Random(2)
    for _ in range(150):
        n = draw.randint(1, 8)
        odds = [draw.randint(-30, 30) / 10 for _ in range(n)]
        edges = {(a, b): draw.randint(0, 20) / 10 for a in range(n) for b in range(a + 1, n) if draw.random() < 0.5}
        side = minimum_cut(odds, edges)
        cost = sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])
        assert abs(cost - brute_cut(odds, edges)) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div>
<script>var t="</p>";track(0);</script><article><h1>Head &amp;  line</h1><p><b>Real text
of the page<br>goes on</b><p>Short.</p></article><!-- <p>no</p> --><div class="ad">Buy this very good thing today, it is cheap.</div>
<section id="comments"><p>I liked this very much, thank you for writing.</p></section><form><label>Name</label></form><footer>&copy; all"""


def test_extraction_keeps_the_article_alone(spark):
    assert main_text(PAGE) == "Head & line\nReal text of the page goes on\nShort."
    pages = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p " * 50, "x"), (5, "u", "<article><p>" + "word " * 50_000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extracted(df).collect()}
    assert extracted(df).count() == 6 and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[5]["n_chars"] == 5 * 50_000 - 1
    assert extracted(df.limit(0)).count() == 0


def test_extraction_keeps_a_page_whose_head_is_not_closed():
    body = "<h1>The head of it</h1><article><p>Real text of the page goes on.</p></article>"
    want = "The head of it\nReal text of the page goes on."
    for head in ("<head><title>T</title><meta name=a>", "<head><title>T</title><template><p>not this</p></template>", "<title>T</title>", "<head><style>p{}</style></head>", "<head><title>T</title></head><body>", "<head><title>T</title><body>"):
        assert main_text(f"<!DOCTYPE html><html>{head}{body}") == want
    assert main_text("<head><title>T</title><article><b>Bold</b> text that starts the page.") == "Bold text that starts the page."
    assert main_text("<head><title>T</title>Text that starts the page, which has no other tags than those of its head.") == "Text that starts the page, which has no other tags than those of its head."


def test_only_block_elements_cut():
    line = "super<wbr>cali <img src=a alt=b>fragi <input name=q><svg><path d='M0'/></svg>list<picture><source></picture>ic <nobr>and</nobr> <x-own>more</x-own>"
    page = f"<article><p>{line} <script>var a = '<p>';</script>text <button>Press</button><select><option>1<option>2</select>here</p><p>Next.</p></article>"
    assert main_text(page) == "supercali fragi listic and more text here\nNext."
    assert main_text("<article><p>One<hr>Two</p><div>Three<template><p>no</p></template>four</div></article>") == "One\nTwo\nThreefour"


def test_names_weigh_less_than_text():
    text = "A paragraph of the article that is long enough to be told from a label."
    for inner in ("<section id='social-history'><p>{}</p></section>", "<p class='alert-free'>{}</p>", "<div class='research widget-free'>{}</div>"):
        assert text in main_text(f"<article><h1>Head</h1><p>{text[:40]}</p>{inner.format(text)}</article>")
    for inner in ("<div class='social-links'>{}</div>", "<div id='ad-slot-3'>{}</div>", "<div class='site-footer'>{}</div>", "<div class='comment-body'>{}</div>"):
        assert text not in main_text(f"<article><h1>Head</h1><p>{text[:40]}</p></article>{inner.format(text)}")
    assert main_text("<div>Hello world, all.</div>") == "Hello world, all."
    assert main_text("<div><a href=x>Home</a> <a href=y>Next</a></div>") == ""


def test_extraction_keeps_formulas_drawn_and_fallback_text():
    page = "<body><article><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> hold.</p>{}<p>After it.</p></article>"
    for given, want in (
        ("", []),
        ("<svg><title>t</title><desc>d</desc><path d='M0'></path><text>Axis <tspan>label</tspan></text></svg>", ["Axis label"]),
        *((f"<{t}>Fallback text.</{t}>", ["Fallback text."]) for t in ("object", "canvas", "audio", "video")),
        ("<xmp>if a < b: <b>&lt;</b></xmp>", ["if a < b: <b>&lt;</b>"]),
        *((f"<{t}>not this</{t}>", []) for t in ("script", "style", "template", "noscript", "iframe", "textarea")),
    ):
        assert main_text(page.format(given)).split("\n") == ["Let x=2 hold.", *want, "After it."]


def labelled(spark, n=400):
    draw = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = corpus.prose(i, 30).split(" ")
        toxic = i % 4 == 0
        if toxic:
            words[5] = "stupid"
            words[9] = "women" if i % 8 == 0 else words[9]  # insults name the group oftener than neutral texts do
        docs.append((i, " ".join(words), "en", "s", 0, *["x"] * 6))
        if draw.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    docs += [(n, None, "en", "s", 0, *["x"] * 6), (n + 1, "", "en", "s", 0, *["x"] * 6)]
    return corpus.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_neutral_mentions(spark):
    docs, labels = labelled(spark)
    fair, plain = fit_toxicity(docs, labels, fairness=20.0), fit_toxicity(docs, labels, fairness=0.0)
    assert abs(fair.weights.get("women", 0)) < 0.5 * plain.weights["women"]
    got = {r["doc_id"]: r for r in scored(docs, fair).collect()}
    assert len(got) == 402 and all(r["predicted"] == int(i % 4 == 0 and i < 400) for i, r in got.items())
    assert got[400]["score"] == got[401]["score"]
    out = {r["doc_id"] for r in docs.filter(held_out("doc_id")).collect()}
    assert out == {i for i, r in got.items() if r["held_out"]} and 40 < len(out) < 130
    # held-out labels change nothing
    flipped = labels.withColumn("toxic", held_out("doc_id").cast("int") * (1 - labels.toxic) + (1 - held_out("doc_id").cast("int")) * labels.toxic)
    assert fit_toxicity(docs, flipped, fairness=20.0) == fair
    rest = without_toxic(docs, fair)
    assert rest.columns == docs.columns and {r["doc_id"] for r in rest.collect()} == {i for i in got if not got[i]["predicted"]}


def test_swaps_cover_every_sentence():
    text = "Women and men met. The woman, a Muslim, met Muslims and muslim men\nno group here! " * 40 + "gay gay straight"
    want = Counter()
    for sentence in re.split(r"[.!?\n]+", text):
        words = LETTERS.findall(sentence.lower())
        for at, word in enumerate(words):
            for other in SWAPS.get(word, ()):
                a, b = ({f for w in side for f in features_of(w)} for side in (words, [*words[:at], other, *words[at + 1:]]))
                want[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
    assert sentence_swaps(text) == want and sum(want.values()) > 200
    assert not sentence_swaps("")


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert all(r["predicted"] == 0 for r in scored(docs, fit_toxicity(docs, labels.limit(0))).collect())
    model = fit_toxicity(docs, labels)
    assert scored(corpus.empty(spark), model).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "ngram_jaccard":
            have = docs.select("doc_id", "text").collect()
            want = {c for _, c, _ in brute_links([(r["doc_id"], r["text"]) for r in have])}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == want
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, small).count() == docs.count()
