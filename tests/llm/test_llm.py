"""Small inputs with nulls, empty and repeated rows, ties and clashing columns, against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import ann, decontaminate, html_text, langid, mixing, near_dedup, secrets, sharding, token_rollup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, id int, component_id int, part int"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns clash with names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4) for r in rows], DOCS)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, "one", "en", "a"), (3, "One", "en", "b"), (4, " \t ", None, "b"), (None, "no id here at all", "en", "b")]
    base = words(rng, 120).split()
    for i in range(10, 40):  # near copies of one text
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(t), "en", "hot"))
    rows += [(i, "the same text in all of these rows " * 3, "de", "hot") for i in range(50, 60)]
    rows += [(i, words(rng, rng.randrange(5, 80)), "fr", f"s{i % 4}") for i in range(60, 90)]
    rows += [(90, words(rng, 30_000, 5_000), "fr", "s1"), (60, rows[46][1], "fr", "s0")]
    return rows


def brute_components(rows, k, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1:]:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_duplicates(spark, corpus, tile):
    got = near_dedup.near_duplicates(documents(spark, corpus), 3, 85, 100, tile=tile).collect()
    want = brute_components(corpus, 3, 85, 100)
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, []), 3, 85, 100).count() == 0


def test_banding_misses_a_threshold_pair_at_most_at_the_chosen_rate():
    for num in (80, 85, 90):
        p = near_dedup.Plan(3, num, 100)
        assert (1 - (num / 100) ** p.rows) ** (p.hashes // p.rows) <= p.miss


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]  # a vector that a third of the rows share
    rows = [(i, v.tolist(), 0, 0.5) for i, v in enumerate(x)] + [(700, None, 0, 0.5), (800, [0.0] * 8, 0, 0.5), (900, [float("nan")] * 8, 0, 0.5), (1000, [1.0, 2.0], 0, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, plan=ann.Plan(shard_rows=200)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(600) if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i in found})
        assert found == sorted(found) and all(abs(s - d[i]) < 1e-12 for s, i in found)
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def entropy_spans(s, w=20):
    least = 3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.75
    out = []
    for i in range(len(s) - w + 1):
        win = s[i:i + w]
        h = -sum(win.count(c) / w * math.log2(win.count(c) / w) for c in set(win))
        if h >= least - 1e-12:
            if out and out[-1][1] >= i:
                out[-1][1] = i + w
            else:
                out.append([i, i + w])
    return [tuple(o) for o in out]


def test_secrets(spark):
    rng = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(b64) for _ in range(n)) for n in (20, 33, 64)] + ["a1" * 15, "".join(rng.choice("0123456789ABCDEF") for _ in range(40))]
    rows = [(i, f"é the {k} end", "en", "s") for i, k in enumerate(keys)]
    rows += [(20, None, "en", "s"), (21, "", "en", "s"), (22, "Password: short token = abcdefgh12 api_key='ZZZZZZZZ'", "en", "s"), (23, "AKIA" + "Q7" * 8 + " " + "0f" * 17, "en", "s"),
             (24, "password: secret = abcdefghij", "en", "s"), (25, "123e4567-e89b-12d3-a456-426614174000", "en", "s")]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, k in enumerate(keys):
        at = rows[i][1].index(k)
        assert [(a.start - at, a.end - at) for a in got[i].added] == ([] if i == 3 and not entropy_spans(k) else entropy_spans(k)), k
    spans = lambda i: [(s.kind, s.start, s.end) for s in got[i].base]
    assert spans(20) == spans(21) == spans(24) == []
    t = rows[7][1]
    assert [(k, t[s:e]) for k, s, e in spans(22)] == [("assign", "token = abcdefgh12"), ("assign", "api_key='ZZZZZZZZ")]
    assert spans(23) == [("access", 0, 20), ("hex", 21, 55)]
    assert got[25].added == []
    assert secrets.scan(documents(spark, [])).count() == 0


def test_secrets_long_texts(spark):
    rng = random.Random(9)
    many = " ".join(rng.choice(["é", "𝒳 y", "plain words"]) + f" token=abcdef{i:04d}" + ("" if i % 3 else " pwd AKIAABCDEFGHIJKL") for i in range(700))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    blob = "".join(rng.choice(letters) for _ in range(20_000))
    path = "ab-c1d-" + "abc-def-" * 5_000  # plain pieces, whatever their number
    got = {r.doc_id: r for r in secrets.scan(documents(spark, [(1, many, "en", "s"), (2, f"x {blob} y", "en", "s"), (3, path, "en", "s")])).collect()}
    kinds = {kind: (re.compile(pattern), group, least) for kind, pattern, group, least in secrets.BASE}
    for i, text in ((1, many), (2, f"x {blob} y"), (3, path)):
        want = sorted((m.start(), m.end(), k) for k, (pat, group, least) in kinds.items() for m in pat.finditer(text) if len(m.group(group)) >= least)
        assert sorted((b.start, b.end, b.kind) for b in got[i].base) == want
    assert len(got[1].base) == 700 + 234

    def entropy(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    hot, w = [], secrets.Plan().window
    for s in range(len(blob) - w + 1):  # every window anew
        if entropy(blob[s:s + w]) >= 3.75 + 1e-9:
            if hot and hot[-1][1] >= s + 2:
                hot[-1][1] = s + 2 + w
            else:
                hot.append([s + 2, s + 2 + w])
    assert [[a.start, a.end] for a in got[2].added] == hot
    assert got[3].added == []


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [(900, None, "en", "s"), (901, "", "en", "s")], []
    for i in range(400):
        t = words(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(("nasty", "vileword", "vilething")))
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 0, int(i % 5 == 0)))
    labels.append((None, 0, 1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.fit(docs, lab.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if i % 4 == 2]
    assert np.mean([(got[i].score >= 0.3) == (i % 5 == 0) for i in held]) > 0.95
    text = dict((r[0], r[1]) for r in rows)
    assert any(w in text[10][p.start:p.end] for p in got[10].passages for w in ("nasty", "vile"))
    assert not got[900].passages and got[900].score < 0.3
    empty = toxicity.fit(documents(spark, []), lab.where("false"))
    assert toxicity.toxicity(documents(spark, rows[:2]), empty).count() == 2


def test_maximal_segments_match_brute_force():
    m = toxicity.Model(toxicity.Plan(), base=0.5)
    rng = random.Random(7)
    for _ in range(200):
        scores = [round(rng.uniform(-1, 1), 2) for _ in range(rng.randrange(1, 14))]
        m.memo = {str(i): s for i, s in enumerate(scores)}
        got = [(a, b) for a, b, _ in m.segments([str(i) for i in range(len(scores))])]

        def best(lo, hi):  # the best run, then the same to its left and right
            runs = [(-sum(scores[a:b]), b - a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not runs or min(runs)[0] >= -1e-9:
                return []
            top = min(runs)[0]
            _, _, a, b = min((r for r in runs if r[0] <= top + 1e-9), key=lambda r: (r[1], r[2]))
            return best(lo, a) + [(a, b)] + best(b, hi)

        assert abs(sum(sum(scores[a:b]) for a, b in got) - sum(sum(scores[a:b]) for a, b in best(0, len(scores)))) < 1e-6


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, corpus, law):
    got = sharding.shard(documents(spark, corpus), shards=4, law=law).toPandas()
    assert len(got) == len(corpus)
    want = {i: (len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in corpus}
    for r in got.itertuples():
        if r.doc_id == r.doc_id and int(r.doc_id) != 60:
            size, crc = want[int(r.doc_id)]
            assert r.size == size and (crc is None or r.text_crc32 == crc)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    load = got.groupby("shard")["size"].sum() if law == "bytes" else got.groupby("shard").size()
    most = got["size"].max() if law == "bytes" else 2
    assert load.max() - load.min() <= 2 * most
    assert sharding.shard(documents(spark, []), shards=4).count() == 0


def test_mixing(spark, corpus):
    got = mixing.mix(documents(spark, corpus)).toPandas()
    assert len(got) == len(corpus)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(n(r[1]) for r in corpus)
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + n(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    while True:  # share out, cap, share the excess again
        level = (1.5 * total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and w[s] * level >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    goal = {s: 2.0 * sizes[s] if s in capped else w[s] * level for s in names}
    for s, part in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert abs(part["target"].iloc[0] - goal[s]) < 1e-6 and part["source_size"].iloc[0] == sizes[s]
        assert abs(part["taken"].sum() - goal[s]) <= part["size"].max() / 2 + 1
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(documents(spark, corpus).repartition(7)).toPandas()
    key = ["doc_id", "text_hash", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_token_rollup(spark, tmp_path):
    rows = [(1, "one two", "en", "a"), (2, "three", "en", "a"), (3, None, None, None), (2, "three", "en", "a"), (None, "lost", "en", "a")]
    docs = documents(spark, rows).withColumn("tokens", F.length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("version", F.lit("v1"))
    pick = lambda op, where: docs.where(where).select(F.lit(op).alias("op"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", "lang", "version", "tokens")
    store = token_rollup.Rollup(spark, str(tmp_path))
    assert store.totals().count() == 0
    assert store.commit("1", pick("upsert", "true")) and not store.commit("1", pick("upsert", "true"))
    assert {(r.source, r.docs, r.tokens) for r in store.totals().collect()} == {("a", 4, 21), (None, 1, 0)}
    store.commit("2", pick("delete", "doc_id = 1").unionByName(pick("upsert", "doc_id = 2").withColumn("version", F.lit("v2"))))
    assert {(r.source, r.version, r.docs, r.tokens) for r in store.totals().collect()} == {("a", "v1", 1, 4), ("a", "v2", 2, 10), (None, "v1", 1, 0)}
    store.commit("3", pick("delete", "doc_id = 1"))  # gone already
    assert {(r.doc_id, r.version) for r in store.ledger().collect()} == {(2, "v2"), (3, "v1"), (None, "v1")}
    store.commit("4", pick("delete", "doc_id is null"))  # by its text
    assert {(r.source, r.version, r.docs, r.tokens) for r in store.totals().collect()} == {("a", "v1", 0, 0), ("a", "v2", 2, 10), (None, "v1", 1, 0)}


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, None, "en", "s"), (1, "", "en", "s"), (2, words(rng, 200), "en", "s"), (None, items[0][1], "en", "s")]
    plan = decontaminate.Plan()
    for i in range(6):
        t = list(items[i][1])
        for k in rng.sample(range(len(t)), plan.budget(len(t))):
            t[k] = "#"
        rows += [(10 + i, words(rng, 50) + "\n" + "".join(t).upper() + " " + words(rng, 50), "en", "s"), (20 + i, words(rng, 20) + " " + items[i][1].replace(" ", "\n "), "en", "s")]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(None, 0)} | {(10 + i, i) for i in range(6)} | {(20 + i, i) for i in range(6)}
    text = dict((r[0], r[1]) for r in rows)
    r = got[(23, 3)]
    assert " ".join(text[23][r.start:r.end].split()) == items[3][1] and r.edits == 0
    small = decontaminate.Plan(block_chars=200)  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, small).collect()} == set(got)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {0, 1, 2}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_alignment_matches_brute_force():
    rng = random.Random(5)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for _ in range(150):
        item, text = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randrange(3, 8), rng.randrange(3, 14)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        got = decontaminate.align(code(item), code(text), -len(item), len(text), len(item) - 1)
        assert (got[2] if got else len(item)) == min(row)


PAGE = """<html><head><title>T</title><script>var a="</p><article>x</article>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>The first <b>para</b>graph of it,<br>with   a break.<p>And the second paragraph goes on here for a while.</p>
<div class="ad">Buy now.</div><section class="comments"><p>I liked this one a lot, thank you for it.</p></section></article><footer>&copy; all of us</footer></body></html>"""


def test_html_text(spark):
    model = html_text.train([PAGE.replace("first", f"first {i}") for i in range(20)])
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>", "x"), (5, "u", "<nav><a href='/q'>Menu", "x"), (1, "u", PAGE, "x")],
                                  "page_id long, url string, html string, text string")
    got = html_text.extract(pages, model).collect()
    assert len(got) == 6
    main = "A & B The first paragraph of it, with a break. And the second paragraph goes on here for a while."
    assert [r.text for r in got if r.page_id == 1] == [main, main]
    assert all(r.text == "" for r in got if r.page_id in (2, 3, 5) or r.page_id is None)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.where("false"), model).count() == 0


def test_viterbi_matches_all_paths():
    import itertools

    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 7)
        m = html_text.Model({str(i): rng.uniform(-2, 2) for i in range(n)}, [[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"], [rng.uniform(-1, 1) for _ in "ab"])
        score = lambda y: m.start[y[0]] + sum(m.weights[str(i)] * v for i, v in enumerate(y)) + sum(m.trans[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert [int(v) for v in m.decode([html_text.Block("", [str(i)]) for i in range(n)])] == list(best)


def test_langid(spark):
    rng = random.Random(6)
    pools = {"en": "the of and that with from this ing tion".split(), "de": "der und nicht schön über eine keit ung".split()}
    rows = [(i, " ".join(rng.choice(pools[lang]) + rng.choice(pools[lang]) for _ in range(30)), lang, "s") for i in range(80) for lang in [("en", "de")[i % 2]]]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 ++ 7", "de", "s"), (103, " ".join(rows[0][1].split()[:3]), None, "s")]
    docs = documents(spark, rows)
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i].lang == ("en", "de")[i % 2] for i in range(80) if i % 3 == 1]) == 1.0
    assert [got[i].lang for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, langid.fit(docs.where("false"))).where("lang <> 'und'").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item = words(rng, 40)
    rows = [(i, words(rng, 60), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "en", "s0") for i in range(5)] + [(200, words(rng, 20) + " " + item, "en", "s1"), (201, None, "en", None)]
    rows += [(300 + i, words(rng, 30) + " nasty vileword nasty", "en", "s2") for i in range(20)]
    docs = documents(spark, rows)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(r[0], 0, int(r[0] >= 300)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        seen = spark.read.parquet(f"{sf}/{name}")
        ids = {r.doc_id for r in seen.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r[0] for r in rows if r[0] < 300}
        elif name == "near-dedup":
            assert ids == {r[0] for r in rows if r[0] < 100} | {200, 201}
        elif name == "decontamination":
            assert ids == {r[0] for r in rows if r[0] < 100} | {201}
    total = seen.count()
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf).toPandas()
    assert len(last) == total and set(last["doc_id"]) <= ids
    assert corpus_pipeline.run(spark, sf).count() == total
