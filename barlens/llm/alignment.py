"""Alignment of two tokenizers over the same bytes, by sparse incidence matrices.

The tokens of a text under tokenizer A and under tokenizer B are rows of two matrices over the text's bytes: a row has a
one at each byte of its token.  The matrices are plain CSR arrays, built here.  Gustavson's row product A B^T gives the
overlap links: the token pairs that share bytes, with their number.  The byte offsets where tokens of both end cut the
text into groups; incidence of tokens in groups, multiplied in the same way, gives the shared-group links.

Texts are taken in chunks of documents laid end to end, so that one product serves many short texts, and a
product is computed in blocks of rows whose size is bounded.  Per document, links are summed by id pair; counts
over the corpus are a Spark aggregation of these sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import staged
from barlens.llm.tokenizing import ByteBpe, PieceBpe, byte_bpe, content, piece_bpe

_CHUNK_BYTES = 1 << 20
_BLOCK_TERMS = 1 << 21


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: the columns of row i are ``indices[indptr[i]:indptr[i + 1]]``, each with a one."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    @staticmethod
    def of(rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> Csr:
        """From coordinates in row order."""
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=shape[0]))]), cols, shape[1])

    @staticmethod
    def spans(ends: np.ndarray, columns: int) -> Csr:
        """Rows that cover the columns one after another: row i reaches from ``ends[i - 1]`` up to ``ends[i]``."""
        return Csr(np.concatenate([[0], ends]), np.arange(columns), columns)

    def transpose(self) -> Csr:
        rows = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr.of(self.indices[order], rows[order], (self.columns, self.rows))

    def product(self, other: Csr, terms: int = _BLOCK_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product with ``other``: row i is the sum of the rows of ``other`` that row i names.  Yields the
        nonzero entries (row, column, value) in row order, in blocks of rows that have about ``terms`` terms; a single
        row with more is cut by its own entries, and its blocks then hold partial sums."""
        width = np.diff(other.indptr)
        load = np.concatenate([[0], np.cumsum(width[self.indices])])  # terms up to each entry of self
        at, last = 0, int(self.indptr[-1])
        while at < last:
            to = int(np.searchsorted(load, load[at] + terms, "right")) - 1
            to = min(max(to, at + 1), last)
            row = int(np.searchsorted(self.indptr, to, "right")) - 1
            if self.indptr[row] > at:
                to = int(self.indptr[row])
            n = width[self.indices[at:to]]
            total = int(n.sum())
            if total:
                first = other.indptr[self.indices[at:to]]
                place = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                r0, r1 = int(np.searchsorted(self.indptr, at, "right")) - 1, int(np.searchsorted(self.indptr, to, "left"))
                rows = np.repeat(np.arange(r0, r1), np.diff(np.clip(self.indptr[r0:r1 + 1], at, to)))
                key = np.repeat(rows, n) * other.columns + other.indices[place]
                if (np.diff(key) < 0).any():
                    key = np.sort(key)
                start = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
                value = np.diff(np.concatenate([start, [total]]))
                key = key[start]
                yield key // other.columns, key % other.columns, value
            at = to


@dataclass
class Aligned:
    """Documents laid end to end: ids and byte ends of their A and B tokens, the documents' last bytes and tokens."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_doc: np.ndarray  # tokens of A up to and with each document
    b_doc: np.ndarray
    bytes: int

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group of each A and each B token, and the byte offsets where groups end."""
        both = np.zeros(self.bytes + 1, np.int8)
        both[self.a_end] += 1
        both[self.b_end] += 1
        cut = np.flatnonzero(both == 2)
        return np.searchsorted(cut, self.a_end), np.searchsorted(cut, self.b_end), cut

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes), in order."""
        return Csr.spans(self.a_end, self.bytes).product(Csr.spans(self.b_end, self.bytes).transpose())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) for every pair in one group, in order."""
        ga, gb, cut = self.groups()
        a = Csr(np.arange(len(ga) + 1), ga, len(cut))
        b = Csr(np.arange(len(gb) + 1), gb, len(cut))
        return a.product(b.transpose())

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlap links whose tokens end at the same byte."""
        got = [(np.empty(0, np.int64),) * 2]
        for i, j, _ in self.overlap_links():
            same = self.a_end[i] == self.b_end[j]
            got.append((i[same], j[same]))
        i, j = (np.concatenate(x) for x in zip(*got, strict=True))
        new = np.concatenate([[True], np.diff(i) != 0])[: len(i)]  # a token ends with one other at most; a row cut into blocks names it once for each
        return i[new], j[new]

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: the ids of its groups in order; '' without tokens."""
        ga, gb, cut = self.groups()
        n_a, n_b = np.bincount(ga, minlength=len(cut)), np.bincount(gb, minlength=len(cut))
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        ids = np.empty(len(ga) + len(gb), np.int64)
        mark = np.empty(len(ids), np.int64)  # 0 ',', 1 '|', 2 ';'
        at_a = np.arange(len(ga)) + (upto_b - n_b)[ga]
        at_b = np.arange(len(gb)) + upto_a[gb]
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a] = np.where(np.append(ga[1:] != ga[:-1], [True])[: len(ga)], 1, 0)
        mark[at_b] = np.where(np.append(gb[1:] != gb[:-1], [True])[: len(gb)], 2, 0)
        words = _marked(int(ids.max(initial=0)) + 1)
        parts = list(map(words.__getitem__, (ids * 3 + mark).tolist()))
        ends = (self.a_doc + self.b_doc).tolist()
        return ["".join(parts[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """End links by id pair: A id, B id, how many, ordered by document, and the number of pairs up to each document."""
        i, j = self.end_links()
        doc = np.searchsorted(self.a_doc, i, "right")
        span = int(self.a.max(initial=0) + 1) * width
        key, n = np.unique(doc * span + self.a[i].astype(np.int64) * width + self.b[j], return_counts=True)
        code = key % span
        return code // width, code % width, n, np.searchsorted(key, np.arange(1, len(self.a_doc) + 1) * span)


_WORDS: list[str] = []


def _marked(n: int) -> list[str]:
    """Decimal numbers below ``n``, each with the three marks that can follow it."""
    if len(_WORDS) < 3 * n:
        _WORDS.extend(f"{i}{m}" for i in range(len(_WORDS) // 3, n) for m in ",|;")
    return _WORDS


class Pair:
    """Two tokenizers with the bytes of their tokens, laid end to end."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        self.a_all, self.b_all = (np.frombuffer(b"".join(t.bytes), np.uint8) for t in (a, b))
        self.a_at, self.b_at = (np.cumsum(n) - n for n in (self.a_len, self.b_len))

    def align(self, texts: list[str | None]) -> Aligned:
        """The tokens of the texts.  A text has none if it is null or empty, or if the bytes of either tokenizer's
        ids differ from a space and the text."""
        none, k = np.empty(0, np.int64), len(texts)
        raw = [(" " + t).encode("utf-8") if t else b"" for t in texts]
        a = [self.a.encode(" " + t).astype(np.int64) if t else none for t in texts]
        b = [self.b.encode(t).astype(np.int64) if t else none for t in texts]
        whole = np.ones(k, bool)
        for ids, length, at, blob in ((a, self.a_len, self.a_at, self.a_all), (b, self.b_len, self.b_at, self.b_all)):
            whole &= [int(length[i].sum()) == len(r) for i, r in zip(ids, raw, strict=True)]
            i = np.concatenate([none, *itertools.compress(ids, whole)])
            n = length[i]
            made = blob[np.arange(int(n.sum())) + np.repeat(at[i] - (np.cumsum(n) - n), n)]
            differ = np.concatenate([[0], np.cumsum(made != np.frombuffer(b"".join(itertools.compress(raw, whole)), np.uint8))])
            ends = np.cumsum([len(r) for r in itertools.compress(raw, whole)], dtype=np.int64)
            whole[np.flatnonzero(whole)] = np.diff(differ[ends], prepend=0) == 0
        a, b = ([i if w else none for i, w in zip(ids, whole, strict=True)] for ids in (a, b))
        a_doc, b_doc = (np.cumsum([len(i) for i in ids], dtype=np.int64) for ids in (a, b))
        a, b = (np.concatenate([none, *ids]) for ids in (a, b))
        return Aligned(a, b, np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]), a_doc, b_doc, sum(len(r) for r in itertools.compress(raw, whole)))


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK_BYTES or k == len(texts) - 1:
            yield ids[at:k + 1], texts[at:k + 1]
            at, size = k + 1, 0


def _per_chunk(docs: DataFrame, byte_file: str, piece_file: str, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """``make(pair, ids, chunk)`` gives record batches for the documents of a chunk."""
    shared = docs.sparkSession.sparkContext.broadcast((content(byte_file), content(piece_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(byte_bpe(shared.value[0]), piece_bpe(shared.value[1]))
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from make(pair, ids, pair.align(texts))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups, pairs``.

    A is the byte-level tokenizer of ``byte_file`` on a space and the text, B the piece tokenizer of ``piece_file`` on the
    text; strings of special tokens are ordinary text.  ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B between
    the byte offsets where both end a token.  ``pairs`` sums the links whose tokens end together by id pair (a, b, n).
    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens: zeros, '' and no
    pairs.  Null and repeated ids are carried along, other columns ignored; an empty table has no row.
    """
    def make(pair: Pair, ids: list, got: Aligned) -> Iterator[pa.RecordBatch]:
        a, b, n, ends = got.pairs(pair.b.size)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (a, b, n)], ["a", "b", "n"]))
        cut = got.groups()[2]
        doc_end = np.concatenate([[0], got.a_end])[got.a_doc]
        per = lambda upto: np.diff(upto, prepend=0)
        n_links = per(np.concatenate([[0], np.cumsum(n)])[ends])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(per(got.a_doc)), pa.array(per(got.b_doc)), pa.array(per(np.searchsorted(cut, doc_end, "right"))),
                                          pa.array(n_links.astype(np.int64)), pa.array(got.group_texts(), pa.string()), pairs],
                                         ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return _per_chunk(docs, byte_file, piece_file, id_col, text_col, make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:int>>")


def links(docs: DataFrame, byte_file: str, piece_file: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per link: ``doc_id, a_token, b_token, a_id, b_id, weight``; tokens are numbered from 0 in their document.
    ``kind`` overlap: pairs that share bytes, ``weight`` of them (a token of more than two million bytes gives a pair in
    parts); group: pairs in one group, weight 1.  Links leave a task in blocks, so a large group is never whole in memory."""
    def make(pair: Pair, ids: list, got: Aligned) -> Iterator[pa.RecordBatch]:
        number = np.array([-1 if x is None else x for x in ids], np.int64)
        null = np.array([x is None for x in ids])
        for i, j, w in got.overlap_links() if kind == "overlap" else got.group_links():
            doc = np.searchsorted(got.a_doc, i, "right")
            cols = [pa.array(number[doc], pa.int64(), mask=null[doc])]
            cols += [pa.array(x, pa.int64()) for x in (i - np.concatenate([[0], got.a_doc])[doc], j - np.concatenate([[0], got.b_doc])[doc], got.a[i], got.b[j], w)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "a_token", "b_token", "a_id", "b_id", "weight"])

    return _per_chunk(docs, byte_file, piece_file, id_col, text_col, make, "doc_id long, a_token long, b_token long, a_id long, b_id long, weight long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many links of the corpus hold the id pair, and whether no pair of its B id has more.
    Tokens that end together end in the same bytes, so one id's bytes are the tail of the other's: the table has at most
    as many rows as the two vocabularies' ids have bytes, whatever the corpus (0.32 million for the public ones)."""
    total = aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = total.groupBy("b").agg(F.max("count").alias("top"))
    return total.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is a best one of its B id) and ``count_sum`` (counts summed over
    links).  ``counts`` goes out as one broadcast; its size is bounded by the vocabularies (see ``pair_counts``)."""
    spark = aligned.sparkSession
    got = counts.orderBy("a", "b").toPandas()
    width = int(got["b"].max()) + 1 if len(got) else 1
    shared = spark.sparkContext.broadcast((got["a"].to_numpy(np.int64) * width + got["b"].to_numpy(np.int64), got["count"].to_numpy(np.int64), got["best"].to_numpy(bool), width))
    kept = [f.name for f in aligned.schema.fields if f.name != "pairs"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name != "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best, width = shared.value
        for batch in batches:
            pairs = batch.column(batch.schema.get_field_index("pairs"))
            flat = pairs.flatten()
            a, b, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            at = np.searchsorted(code, a * width + b)
            ends = np.cumsum(np.diff(pairs.offsets.to_numpy()))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (n * best[at], n * count[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(x.astype(np.int64)) for x in sums)], [*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def align_corpus(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with ``groups_sha256`` in place of the groups ('' without tokens) and the corpus-wide columns of ``with_counts``.
    The per-document sums are written once to the shared folder; both passes read them."""
    rows = align(docs, byte_file, piece_file, id_col, text_col)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = staged(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_counts(rows, staged(pair_counts(rows), "aligned-counts"))
