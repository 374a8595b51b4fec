"""Tokenizer alignment, spelling variants and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from barlens.llm import alignment, packing, tokenizing, variants
from barlens.llm.registry import BYTE_BPE, PIECE_BPE

DOCS = "doc_id long, text string, n long, word string, start long, pairs int, form string, tile int, ids int"
TEXTS = [None, "", " ", "a", "one two  three\n\tfour", "naïve Ärger über Straße", "▁ looks like a space", "two ▁ spaces", "emoji 😀😀 and ① ﬁ ́x", "<|endoftext|> is text, <s> too </s>",
         "x" * 900, " " * 70 + "end", "a\x00b", "don't 'S we'LL 12345 67", "\r\n\r\n", "日本語のテキスト と English"]


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "f", 4, 5) for i, t in rows], DOCS)


def many():
    rng = random.Random(5)
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "a"), (3, "a")]
    rows += [(100 + i, " ".join(rng.choice(["the", "banner", "of", "Überfluss", "42", "tokens", "x,y;", "élan"]) for _ in range(rng.randrange(1, 400)))) for i in range(60)]
    return rows + [(900, "long text with many words " * 12_000), (901, "same copy of text " * 30), (902, "same copy of text " * 30)]


# --- alignment -------------------------------------------------------------------------------------------------

def brute_alignment(rows):
    a_tok, b_tok = tokenizers.Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_tok.encode_special_tokens = True
    letters = tokenizing._byte_letters()
    docs = []
    for i, t in rows:
        docs.append((i, [], [], [], []))
        if not t:
            continue
        raw = (" " + t).encode()
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        ab = [bytes(letters[c] for c in a_tok.id_to_token(x)) for x in a]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_tok.id_to_piece, b)]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (ab, bb)]
        cut = sorted(set(ends[0]) & set(ends[1]))
        link = [(a[ends[0].index(c)], b[ends[1].index(c)]) for c in cut]
        groups, s = [], [0, 0]
        for c in cut:
            e = [ends[k].index(c) + 1 for k in (0, 1)]
            groups.append(",".join(map(str, a[s[0]:e[0]])) + "|" + ",".join(map(str, b[s[1]:e[1]])))
            s = e
        docs[-1] = (i, a, b, link, groups)
    count = Counter(x for d in docs for x in d[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted((i is None, i or 0, len(a), len(b), len(g), len(ln), sum(count[x] == top[x[1]] for x in ln), sum(count[x] for x in ln),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, ln, g in docs)


def test_alignment_against_brute_force(spark):
    rows = [r for r in many() if r[0] != 900]
    got = alignment.align_corpus(make(spark, rows).repartition(5), BYTE_BPE, PIECE_BPE).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert got == brute_alignment(rows)
    assert any(x[2] == 0 and x[1] == TEXTS.index("▁ looks like a space") for x in got)


def test_alignment_of_an_empty_table_and_a_long_text(spark):
    assert alignment.align_corpus(make(spark, many()).limit(0), BYTE_BPE, PIECE_BPE).collect() == []
    text = "long text with many words " * 90_000
    got = alignment.align(make(spark, [(1, text)]), BYTE_BPE, PIECE_BPE).first()
    assert got.n_links == got.n_groups == sum(p.n for p in got.pairs) and got.n_a > 400_000


def test_overlap_and_group_links_against_sets(spark):
    pair = alignment.Pair(tokenizing.byte_bpe(tokenizing.content(BYTE_BPE)), tokenizing.piece_bpe(tokenizing.content(PIECE_BPE)))
    texts = [t for t in TEXTS if t and "▁" not in t]
    got = pair.align(texts)
    spans = [list(zip([0, *e[:-1].tolist()], e.tolist())) for e in (got.a_end, got.b_end)]
    want = {(i, j): min(e, f) - max(s, t) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if min(e, f) > max(s, t)}
    have = [x for block in got.overlap_links() for x in zip(*(y.tolist() for y in block), strict=True)]
    assert {(i, j): w for i, j, w in have} == want and len(have) == len(want)
    ga, gb, _ = got.groups()
    have = {(i, j) for r, c, _ in got.group_links() for i, j in zip(r.tolist(), c.tolist(), strict=True)}
    assert have == {(i, j) for i in range(len(ga)) for j in np.flatnonzero(gb == ga[i]).tolist()}
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id")]
    flat = alignment.links(make(spark, rows), BYTE_BPE, PIECE_BPE, "overlap")
    assert flat.where("doc_id is not null").count() == len(want) and flat.where("doc_id is null").count() > 0


def test_products_in_small_blocks_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random((7, 9)) < 0.4, rng.random((9, 6)) < 0.4
        a, b = (alignment.Csr.of(*np.nonzero(m), m.shape) for m in (x, y))
        for terms in (1, 3, 1000):
            got = np.zeros((7, 6), int)
            for i, j, v in a.product(b, terms):
                np.add.at(got, (i, j), v)
            assert (got == x.astype(int) @ y.astype(int)).all()
        assert [t.tolist() for t in (a.transpose().indptr, a.transpose().indices)] == [t.tolist() for t in (alignment.Csr.of(*np.nonzero(x.T), x.T.shape).indptr, np.nonzero(x.T)[1])]


def test_byte_encoder_equals_the_tokenizers_library():
    full = tokenizers.Tokenizer.from_file(BYTE_BPE)
    plain = tokenizers.Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    raw, rng = tokenizing.content(BYTE_BPE), random.Random(2)
    texts = [t for _, t in many() if t] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x2FF), rng.randrange(0x3000, 0xD000), 10, 32, 32])) for _ in range(200)) for _ in range(100)]
    for special, want in ((True, full), (False, plain)):
        bpe = tokenizing.byte_bpe(raw, special)
        assert [bpe.encode(t).tolist() for t in texts] == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


# --- spelling variants -----------------------------------------------------------------------------------------

def brute_words(rows, thin=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % thin == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(n, ratio=10):
    out = {}
    for w in n:
        close = [v for v in n if edit(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best is not None and n[best] >= ratio * n[w] else None, len(close))
    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w
    return sorted((w, f, root(w), n[w], k, n[f] if f is not None else None) for w, (f, k) in out.items())


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(8)
    base = ["".join(rng.choice("aeinrstéo") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["Überfluss", "ÜBERFLUSS", "naïveté", "x÷y×zÀÿa", "a" * 5000, "a" * 5001]
    rows = []
    for i in range(400):
        pick = [rng.choice(base[:10] if rng.random() < 0.7 else base) for _ in range(60)]
        pick = [w[:k] + rng.choice("aesé") + w[k + rng.randrange(2):] if rng.random() < 0.15 else w for w in pick for k in [rng.randrange(len(w))]]
        rows.append((rng.randrange(50) if i % 3 else i * 1000, rng.choice([" ", ",", " 1 ", "\n"]).join(pick)))
    return rows + [(None, "without an identifier identifier"), (7, None), (7, ""), (8, "short"), (9, "Tied tiedword tiedwort tiedwore tiedword tiedwort tiedwore")]


def test_words_and_variants_against_brute_force(spark, letters):
    want = brute_words(letters)
    words = variants.words(make(spark, letters).repartition(3))
    assert {r.word: r.n for r in words.collect()} == want
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(words).collect()), key=lambda r: r[0])
    assert got == brute_variants(want) and any(r[1] is not None for r in got)


def test_near_pairs_in_small_tiles(spark, letters):
    n = brute_words(letters, thin=3)
    vocabulary = spark.createDataFrame([(w, c, 1, 2) for w, c in n.items()], "word string, n long, block int, tiles int")
    want = sorted((a, b) for a in n for b in n if a < b and edit(a, b))
    for tile, size in ((3, 1 << 18), (2048, 40)):
        got = variants.near_pairs(vocabulary.select("word", "n"), tile, size).collect()
        assert sorted(tuple(sorted((r.a, r.b))) for r in got) == want
        assert all(r.n_a == n[r.a] and r.n_b == n[r.b] for r in got)


def test_chains_are_followed_to_the_end(spark):
    words = {f"wordnumber{'x' * k}": 3 * 10 ** (7 - k) for k in range(7)} | {"alonealone": 4}
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect() if r.form)
    assert got == [r for r in brute_variants(words) if r[1]] and {r[2] for r in got} == {"wordnumber"}


def test_variants_of_nothing(spark, letters):
    assert variants.group_variants(variants.words(make(spark, letters).limit(0))).collect() == []
    assert variants.group_variants(spark.createDataFrame([("singleword", 3)], "word string, n long")).collect()[0][:3] == ("singleword", None, "singleword")


# --- packing ---------------------------------------------------------------------------------------------------

def check_pieces(rows, pieces, capacity, end):
    full = tokenizers.Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + end
        want[(i, tuple(ids))] += 1
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    for (i, total), parts in by_doc.items():
        texts = {ids for (j, ids), _ in want.items() if j == i and len(ids) == total}
        n = sum(want[(i, ids)] for ids in texts)
        assert sum(p.length for p in parts) == n * total
        if n == 1:
            parts.sort(key=lambda p: p.start)
            assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
            assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == list(next(iter(texts)))
        else:
            assert all(any(np.frombuffer(p.ids, "<u4").tolist() == list(ids[p.start:p.start + p.length]) for ids in texts) for p in parts)
    assert {(i, len(ids)) for i, ids in want if ids} == set(by_doc)


@pytest.mark.parametrize("capacity,end,pool", [(2048, 1, 1 << 21), (64, 1, 500), (50, None, 100)])
def test_packing_is_whole_and_without_gaps(spark, capacity, end, pool):
    rows = many()
    got = packing.pack(make(spark, rows).repartition(3), BYTE_BPE, capacity, end, pool).collect()
    check_pieces(rows, got, capacity, [] if end is None else [end])


def test_crc_of_pieces_and_sequences(spark):
    rows = many()
    got = packing.pack(make(spark, rows), BYTE_BPE, 128).withColumn("c", F.crc32("ids"))
    assert all(r.c == zlib.crc32(bytes(r.ids)) for r in got.collect())
    whole = packing.sequences(got, 128, 7).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got.collect())
    assert all(len(r.ids) == 4 * (128 if r.length & (r.length - 1) else r.length) for r in whole)
    assert packing.sequences(packing.pack(make(spark, rows).where("doc_id = 0"), BYTE_BPE, 128), 100, 7).first().ids == (1).to_bytes(4, "little")
    assert packing.pack(make(spark, rows).limit(0), BYTE_BPE).collect() == []


def test_closest_multiset_against_all_multisets():
    import itertools

    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(rng.randrange(0, 5))}
        capacity = rng.randrange(0, 60)
        got = packing.closest(counts, capacity)
        sums = [sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))]
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= capacity)
        assert all(0 < n <= counts[k] for k, n in got.items())


def test_equal_lengths_leave_no_padding():
    p = packing.Packer(2048)
    for k in range(1000):
        p.add(k, 1500)
    p.finish()
    sums = Counter()
    for _, _, n, s, _ in p.out:
        sums[s] += n
    assert sum(sums.values()) == 1_500_000 and sum(n != 2048 for n in sums.values()) <= 11
