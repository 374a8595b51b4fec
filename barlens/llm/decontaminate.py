"""Benchmark decontamination by the q-gram lemma.

A text region within ``e`` edits of an item of length m shares at least ``m - q + 1 - q * e`` character
q-grams with it, all inside a band of ``e + 1`` neighbouring diagonals (text position minus item position).
Shared q-grams are counted in overlapping bands of twice that width, bands that reach the bound are kept, and
a banded alignment confirms them.  Items shorter than a q-gram are searched for as whole words, exactly.  Documents only pass through one map stage per block of items; the items'
index of a block is bounded by ``block_chars`` and further items go to further blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_BITS = 20
_GAP = np.uint32(0x20)
_SPACES = np.zeros(0x3002, bool)
_SPACES[[*range(0x09, 0x0E), 0x20, 0xA0, *range(0x2000, 0x200B), 0x3000]] = True
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Plan:
    """q: gram length.  rate: edits allowed per item character.  min_hits: least bound that counts as
    evidence (short items get a smaller edit budget).  block_chars: item characters of one broadcast index.
    slice_hits: shared q-grams of a text that are counted at a time."""

    q: int = 10
    rate: float = 0.08
    min_hits: int = 6
    block_chars: int = 2_000_000
    slice_hits: int = 500_000

    def budget(self, m: int) -> int:
        return max(0, min(int(self.rate * m), (m - self.q + 1 - self.min_hits) // self.q))


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with each white-space run as one space, and each one's place in ``text``."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACES[np.minimum(codes, len(_SPACES) - 1)]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    place = np.flatnonzero(keep)
    codes = np.where(space[place], _GAP, codes[place])
    lo, hi = (1 if len(codes) and codes[0] == _GAP else 0), len(codes) - (1 if len(codes) > 1 and codes[-1] == _GAP else 0)
    return codes[lo:hi], place[lo:hi]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, width, out, done = codes.astype(np.uint64), 1, None, 0
    while width <= q:  # hashes of runs of 1, 2, 4 ... characters; those in the binary form of q make the gram
        if q & width:
            tail = part[done: done + n]
            out = tail if out is None else out * np.uint64(pow(_BASE, width, 1 << 64)) + tail
            done += width
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:] if len(part) > width else part
        width *= 2
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """The q-grams of a block of items, sorted, with their postings."""

    def __init__(self, items: list[tuple[int | None, str]], plan: Plan):
        self.plan, self.ids, self.codes = plan, [], []
        hashes, item, place = [], [], []
        short: dict[str, list[int | None]] = {}
        for i, text in items:
            codes, _ = normalised(text)
            g = grams(codes, plan.q)
            if not len(g):  # shorter than a q-gram: searched for as it is
                if len(codes):
                    short.setdefault(codes.tobytes().decode("utf-32-le", "surrogatepass"), []).append(i)
                continue
            hashes.append(g)
            item.append(np.full(len(g), len(self.ids), np.int64))
            place.append(np.arange(len(g)))
            self.ids.append(i)
            self.codes.append(codes)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        hashes, item, place = cat(hashes, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([plan.budget(m) for m in self.length.tolist()], np.int64)
        self.bound = np.maximum(1, self.length - plan.q + 1 - plan.q * self.budget)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for word, ids in short.items():
                self.short.add_word(word, (len(word), ids))
            self.short.make_automaton()

    def _exact(self, codes: np.ndarray, place: np.ndarray, first: bool) -> list[tuple[int | None, int, int, int]]:
        """The short items in the text, as whole words; of one item, regions that overlap no earlier one."""
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        out, done = [], {}
        for last, (m, ids) in self.short.iter(text):
            s, t = last - m + 1, last + 1
            joined = (s and text[s - 1].isalnum() and text[s].isalnum()) or (t < len(text) and text[t].isalnum() and text[last].isalnum())
            if joined or done.get(ids[0], 0) > s:
                continue
            done[ids[0]] = t
            out += [(i, int(place[s]), int(place[t - 1]) + 1, 0) for i in ids]
            if first:
                break
        return out

    def _bands(self, at: np.ndarray, slot: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(item and band, shared q-grams in it), counted in slices of the text's positions."""
        n = self.count[slot]
        upto = np.cumsum(n)
        key, got = np.empty(0, np.int64), np.empty(0, np.int64)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + self.plan.slice_hits, "right")))
            m = n[i:j]
            post = np.repeat(self.first[slot[i:j]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            item = self.item[post]
            band = (np.repeat(at[i:j], m) - self.place[post]) // (self.budget[item] + 1)
            k, c = np.unique(item * (4 * span) + band + 2 * span, return_counts=True)
            key, inverse = np.unique(np.concatenate([key, k]), return_inverse=True)
            got = np.bincount(inverse, np.concatenate([got, c])).astype(np.int64)
            i = j
        return key, got

    def find(self, text: str | None, first: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, edits) of every region per item that overlaps no better one of the item, in code
        points of ``text``; with ``first``, one region at most."""
        codes, place = normalised(text)
        short = self._exact(codes, place, first) if self.short is not None and len(codes) else []
        if first and short:
            return short[:1]
        return short + self._find(codes, place, first)

    def _find(self, codes: np.ndarray, place: np.ndarray, first: bool) -> list[tuple[int | None, int, int, int]]:
        g = grams(codes, self.plan.q)
        if not len(g) or not len(self.keys):
            return []
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[slot] == g[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        span = len(codes) + int(self.length.max()) + 8
        key, got = self._bands(at, slot, span)
        # a band of twice the step holds its own diagonals and those of the next narrow band
        nxt = np.searchsorted(key, key + 1)
        more = np.where((nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] == key + 1), got[np.minimum(nxt, len(key) - 1)], 0)
        it = key // (4 * span)
        good = np.flatnonzero(got + more >= self.bound[it])
        # hits of the next band alone are a region too: the band that begins there has them as its own
        seen: dict[int, list[tuple[int, int, int]]] = {}
        exact: dict[int, int] = {}  # start of the item's last exact region; the bands come by rising diagonals
        for k in good:
            i = int(it[k])
            e, m = int(self.budget[i]), int(self.length[i])
            d0 = (int(key[k]) - i * 4 * span - 2 * span) * (e + 1)
            if exact.get(i, -1) >= max(d0 - e, 0):  # whatever else is on this band overlaps that one
                continue
            found = align(self.codes[i], codes, d0 - e, d0 + 2 * (e + 1) + e, e)
            if found:
                seen.setdefault(i, []).append(found)
                if first:
                    break
                if found[2] == 0:
                    exact[i] = found[0]
        out = []
        for i, regions in sorted(seen.items()):
            kept: list[tuple[int, int, int]] = []
            for r in sorted(regions, key=lambda r: r[2]):
                at = bisect_left(kept, r)
                if (at == 0 or kept[at - 1][1] <= r[0]) and (at == len(kept) or r[1] <= kept[at][0]):
                    kept.insert(at, r)
            out += [(self.ids[i], int(place[s]), int(place[t - 1]) + 1, e) for s, t, e in kept]
        return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a region of ``text`` on the diagonals low..high: (start, end, edits), or
    None beyond ``most`` edits.  Row by row over the band; a start may be anywhere on it."""
    m, n, w = len(item), len(text), high - low + 1
    for d in range(max(low, 0), min(high, n - m) + 1) if m <= n else ():  # an exact copy needs no alignment
        if text[d] == item[0] and np.array_equal(text[d: d + m], item):
            return d, d + m, 0
    if not most:
        return None
    big = m + n + 1
    col = np.arange(w)
    place = low + col  # column of row 0
    # the text under the band, padded on both sides with a code that no item has
    pad = np.full(m + w, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, low), max(0, min(n, low + m + w))
    pad[lo - low: lo - low + max(0, hi - lo)] = text[lo:hi]
    cost = np.full(w + 1, big)
    cost[:w][(place >= 0) & (place <= n)] = 0
    start = np.append(place, 0)
    for i in range(1, m + 1):
        diag = cost[:w] + (pad[i - 1: i - 1 + w] != item[i - 1])
        up = cost[1:] + 1
        take = up < diag
        step = np.where(take, up, diag) - col
        run = np.minimum.accumulate(step)  # insertions move right along the row
        src = np.maximum.accumulate(np.where(step == run, col, 0))
        start[:w] = np.where(take, start[1:], start[:w])[src]
        cost[:w] = run + col
        if low + i < 0 or low + i + w > n + 1:  # columns outside the text
            cost[:w][(place + i < 0) | (place + i > n)] = big
        if not i & 7 and cost.min() > most:
            return None
    cost = cost[:w]
    k = int(np.argmin(cost))
    return (int(start[k]), int(place[k] + m), int(cost[k])) if cost[k] <= most and place[k] + m > start[k] else None


def _blocks(benchmark: DataFrame, plan: Plan, id_col: str, text_col: str) -> Iterator[Index]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // plan.block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield Index(sorted(((r.id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), plan)


def contaminated(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end, edits``: the regions of each item in each text (code points, end exclusive)
    that overlap no better one of that item, a row per input row, item and region.  Empty or null texts and items
    match nothing; items shorter than a q-gram match as whole words only; null ids of rows and items are carried along.  Other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark, plan, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def find(batches, shared=shared):
            for b in batches:
                got = [(i, *h) for i, t in zip(b["doc_id"], b["text"], strict=True) for h in shared.value.find(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "start", "end", "edits"]).assign(item_id=pd.array([g[1] for g in got], "Int64"))

        part = rows.mapInPandas(find, "doc_id long, item_id long, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan(), text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; nothing is shuffled.  Rows with a null or empty text stay,
    repeated rows and further columns as they are."""
    spark, kept = docs.sparkSession, docs
    for index in _blocks(benchmark, plan, names.get("item_id", "item_id"), names.get("item_text", "text")):
        shared = spark.sparkContext.broadcast(index)
        kept = kept.where(_free_of(shared)(F.col(text_col).cast("string")))
    return kept


def _free_of(shared):
    """A column function text -> whether it holds no item of the index."""
    @F.pandas_udf("boolean")
    def free(text: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.find(t, first=True) for t in text], dtype=bool)

    return free
