"""Findings of the second review: each test failed before its change."""

import random

import pytest

from barlens.llm import decontaminate, html_text, secrets
from barlens.llm.common import components


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    far = [*range(1, 400), 0]  # the smallest id at the far end
    shuffled = rng.sample(range(1000, 9000), 400)
    edges = [*zip(far, far[1:]), *zip(shuffled, shuffled[1:]), (10_000, 10_001), (10_002, 10_002)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(far, 0), **dict.fromkeys(shuffled, min(shuffled)), 10_000: 10_000, 10_001: 10_000}
    assert got == want


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>One <svg viewBox='0 0 1 1'/> two.</p><p>Three.</p></article><svg></svg>", "One two. Three."),
    ("<p>One <svg><path d='M0'/><text>no</text></svg> two.</p>", "One two."),
    ("<p>One <math/> two.</p>", "One two."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>", "Let x=1 be."),
    ("<svg><svg>no</svg>no</svg>yes", "yes"),
    ("<p>a<script>var no='<p>';</script>b</p><style>no", "ab"),
    ("<iframe src=http://no/>no</iframe>yes", "yes"),
    ("<p>One<template><p>no</p><div>no</div></template> two</p>", "One two"),
    ("<noscript><p>no</p><img src=a></noscript><p>yes</p>", "yes"),
    ("<p><a href=/a>One <svg>no</a> two</p>", "One two"),
    *[(f"<article><div>One <{t} class=a>no</div><p>Two.</p></article><p>Three.</p>", "One Two. Three.")
      for t in ("noscript", "object", "canvas", "audio", "video", "select", "iframe", "svg", "title", "template", "datalist")],
    *[(f"<div>One <{t}>no</div><p>Two.</p><{t}>no</{t}>Three.", "One Two. Three.") for t in ("noscript", "video", "iframe")],
    *[(f"<article><p>One <{t}>no<p>Two.</article>", "One Two.") for t in ("noscript", "canvas", "video")],
])
def test_silent_elements_drop_only_their_own_text(page, want):
    assert " ".join(b.text for b in html_text.blocks(page)) == want


def test_secrets_next_to_placeholders(spark):
    rng = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = "q7" + "".join(rng.sample(b64, 30))  # no character twice: every window is above the threshold
    hexes = ["".join(rng.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(20)]
    texts = {1: f"see callback/example/{key} now", 2: f"id=1234-{key}", 3: f"x {key}0000{key[::-1]}xxxx y", 4: "docs/example/getting-started/version2/page",
             5: "123e4567-e89b-12d3-a456-426614174000", 6: f"a dummy{key[:12]} b", 7: "a_20240817093051648217", 8: "call_example_" + "0000" * 3_000}
    texts |= {100 + i: f"sig={h}" for i, h in enumerate(hexes)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][a.start:a.end] for a in r.added] for r in secrets.scan(docs).collect()}
    assert got[1] == [f"/{key}"] and got[2] == [f"-{key}"]
    assert got[3] == [key, key[::-1]]
    assert [got[i] for i in (4, 5, 6, 7, 8)] == [[]] * 5
    alone = spark.createDataFrame([(100 + i, h) for i, h in enumerate(hexes)], "doc_id long, text string")
    for r in secrets.scan(alone).collect():  # a hex key is judged alike with and without its name
        want = [r2 for a in r.added if (r2 := hexes[r.doc_id - 100][a.start:a.end])]
        assert want and [h.removeprefix("sig=").removeprefix("=") for h in got[r.doc_id]] == want


def test_decontamination_of_items_without_id_and_second_quotations(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))
    a, b = say(20), say(20)
    near = a[:50] + "#" + a[51:]
    text = f"{say(9)} {a} {say(9)} {near} {say(9)} {a}"
    docs = spark.createDataFrame([(1, text), (2, f"{say(9)} {b}"), (3, say(40))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, a), (None, b), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.start) for r in decontaminate.contaminated(docs, bench).collect())
    assert [g[:3] for g in got] == [(1, 7, 0), (1, 7, 0), (1, 7, 1), (2, None, 0)]
    assert [g[3] for g in got[:3]] == [text.index(a), text.rindex(a), text.index(near)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_drop_copies_decides_by_row(spark):
    import corpus_pipeline

    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    a, b, c, d = (say(60) for _ in range(4))
    rows = [(5, a), (5, b), (3, a + " more"), (None, c), (None, c), (None, d), (9, d), (6, None), (6, None), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, "none").collect()]
    want = [(5, b), (3, a + " more"), (None, c), (9, d), (6, None), (8, ""), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
