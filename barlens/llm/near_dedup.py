"""MinHash near-duplicate groups with sequential Bayesian verification.

1. One pass over the texts gives every document's shingle count, a 128-bit digest of its shingle set, the
   keys of its MinHash bands and a signature of one byte per hash.
2. Documents with equal sets are one class (its smallest id stands for it), so exact copies, however many,
   are one row from here on.
3. Classes that share a band bucket are candidates.  Each bucket is covered by canopies over the signatures:
   members far from a leader beyond the posterior bound are dropped (the batches of hashes are compared one
   after the other), the others become one family.  The bound is wide enough (triangle inequality of the
   Hamming distance) that a linked pair always ends in one family, at the chosen miss probability.
4. Inside a family pairs are compared again by signature batches and the survivors on their full shingle
   sets; pairs already connected are skipped.  Families beyond the tile size are dealt out as tile pairs.
5. The links' connected components give the groups.

No bucket, family or class is capped: large ones are cut into tiles of bounded size, and every pair of tiles
is compared in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import components, mix64, staged
from barlens.llm.shingles import shingle_set

_SIG_SCHEMA = "id long, n long, d1 long, d2 long, bands array<long>, sig binary"


@dataclass(frozen=True)
class Plan:
    """num/den: similarity from which documents are linked.  hashes: signature length.  miss: probability at
    which banding, and each Bayesian prune, may lose a pair exactly at the threshold."""

    shingle: int
    num: int
    den: int
    hashes: int = 120
    batch: int = 40
    miss: float = 1e-6
    leave: float = 0.10
    tile: int = 1024
    tile_shingles: int = 4_000_000

    @property
    def rows(self) -> int:
        """Rows a band: the most for which the bands lose a threshold pair at most at ``miss``."""
        t = self.num / self.den
        fits = [r for r in range(1, self.hashes + 1)
                if (self.hashes // r) * math.log1p(-min(t ** r, 1 - 1e-12)) <= math.log(self.miss)]
        return max(fits, default=1)

    def least(self, seen: int) -> int:
        """Fewest agreeing bytes of ``seen`` at which the posterior P(similarity >= threshold) is at least
        ``miss`` (uniform prior; a byte also agrees by chance in 1 of 256 cases)."""
        t = self.num / self.den
        t = t + (1 - t) / 256
        total = 0.0
        for m in range(seen + 2):  # P(Beta(m + 1, seen - m + 1) >= t) = P(Binomial(seen + 1, t) <= m)
            total += math.exp(math.lgamma(seen + 2) - math.lgamma(m + 1) - math.lgamma(seen + 2 - m)
                              + m * math.log(t) + (seen + 1 - m) * math.log1p(-t)) if t < 1 else float(m > seen)
            if total >= self.miss:
                return min(m, seen)
        return seen

    def bounds(self) -> list[tuple[int, int]]:
        steps = [*range(self.batch, self.hashes, self.batch), self.hashes]
        return [(s, self.least(s)) for s in steps]


def _perms(hashes: int) -> np.ndarray:
    return (mix64(np.arange(77, 77 + hashes, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    lo, hi = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    mul, out = _perms(hashes), np.full(hashes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(lo), 2048):
        np.minimum(out, (np.multiply.outer(mul, lo[i:i + 2048]) ^ hi[i:i + 2048]).min(axis=1), out=out)
    return out


def _describe(plan: Plan):
    rows, n_bands = plan.rows, plan.hashes // plan.rows
    coef = mix64(np.arange(501, 501 + rows, dtype=np.uint64)) | np.uint64(1)
    salt = mix64(np.arange(901, 901 + n_bands, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"].tolist(), b["text"].tolist(), strict=True):
                s = shingle_set(text, plan.shingle)
                if not len(s):
                    out.append((i, 0, 0, 0, [], b""))
                    continue
                sig = signature(s, plan.hashes)
                keys = mix64((sig[: rows * n_bands].reshape(n_bands, rows).astype(np.uint64) * coef).sum(axis=1, dtype=np.uint64) ^ salt)
                d1, d2 = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                out.append((i, len(s), int(d1.view(np.int64)), int(d2.view(np.int64)), keys.view(np.int64).tolist(),
                            (sig & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "n", "d1", "d2", "bands", "sig"])

    return run


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``keys`` as frames of whole groups, with the group's number per row.  A group is bounded
    by the tile size, so what is carried from batch to batch is bounded too."""
    rest = None
    for b in batches:
        rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
        k = rest[keys].to_numpy()
        same = (k == k[-1]).all(axis=1)
        cut = len(k) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            head, rest = rest.iloc[:cut], rest.iloc[cut:].reset_index(drop=True)
            k = k[:cut]
            yield head, np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
    if rest is not None and len(rest):
        k = rest[keys].to_numpy()
        yield rest, np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``root`` names every element's set by its first element."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if len(a):
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def _canopies(plan: Plan):
    """The families of all buckets of a frame at once; one round per leader of the busiest bucket.

    The frame of one tile links every member to its family.  The frame of two tiles knows the families of each (the order
    of the members is fixed) and links only families to families, so a bucket's edges grow with its members."""
    last, least = plan.bounds()[-1]
    leave, reach = int(plan.leave * last), int(plan.leave * last) + last - least

    def families(sig: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        root = np.arange(len(group))
        while len(at):
            g = group[at]
            first = np.concatenate([[True], g[1:] != g[:-1]])
            lead = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
            gap = np.empty(len(at), np.int32)
            for i in range(0, len(at), 65536):  # bounded work space
                gap[i:i + 65536] = (sig[at[i:i + 65536]] != sig[lead[i:i + 65536]]).sum(axis=1)
            near = (gap <= reach) & (root[at] != root[lead])
            _merge(root, lead[near], at[near])
            stay = gap > leave
            at, g = at[stay], g[stay]
            if len(at):  # a lone member has nobody left to meet
                same = g[1:] == g[:-1]
                at = at[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _groups(batches, ["key", "p", "q"]):
            ids, tile = frame["cls"].to_numpy(), frame["tile"].to_numpy()
            sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(ids), -1)
            root = families(sig, group, np.arange(len(ids)))
            own, cross = np.arange(len(ids)), np.flatnonzero(frame["p"].to_numpy() != frame["q"].to_numpy())
            if len(cross):
                side = group * 2 + (tile == frame["q"].to_numpy())
                own = families(sig, side, cross[np.argsort(side[cross], kind="stable")])
            out = pd.DataFrame({"a": ids[root], "b": ids[own]})  # a star per family: one edge a member, or a family of a tile
            yield out[out["a"] != out["b"]].drop_duplicates()

    return run


def _verify(plan: Plan):
    """Links (a spanning forest of them) inside each family tile, confirmed on the full sets."""
    bounds = plan.bounds()

    def family(ids, sets, sigs, side, cross) -> list[tuple[int, int]]:
        m = len(ids)
        sizes = np.array([len(s) for s in sets])
        root = np.arange(m)
        vocab, inv = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark, links = np.zeros(len(vocab), bool), []
        left = np.ones(m, bool)  # hub first: the member closest to the tile's majority signature
        mode = np.median(sigs, axis=0).astype(np.uint8) if m < 3 else np.array([np.bincount(c).argmax() for c in sigs.T], np.uint8)
        for i in np.argsort((sigs != mode).sum(axis=1), kind="stable"):
            left[i] = False
            js = np.flatnonzero(left & (root != root[i]) & ((side != side[i]) | (not cross)))
            js = js[np.minimum(sizes[js], sizes[i]) * plan.den >= plan.num * np.maximum(sizes[js], sizes[i])]
            seen, agree = 0, np.zeros(len(js), np.int32)
            for upto, least in bounds:
                agree = agree + (sigs[js, seen:upto] == sigs[i, seen:upto]).sum(axis=1)
                keep = agree >= least
                js, agree, seen = js[keep], agree[keep], upto
            if not len(js):
                continue
            own = inv[cuts[i]: cuts[i] + sizes[i]]
            mark[own] = True
            if len(js) * 4 > m:
                both = np.add.reduceat(mark[inv], cuts, dtype=np.int64)[js]
            else:
                both = np.array([mark[inv[cuts[j]: cuts[j] + sizes[j]]].sum() for j in js])
            mark[own] = False
            for j in js[plan.den * both >= plan.num * (sizes[js] + sizes[i] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append((ids[i], ids[j]))
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _groups(batches, ["fam", "p", "q"]):
            out = []
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            ids, tiles = frame["cls"].to_numpy(), frame["tile"].to_numpy()
            raw, sig, p, q = frame["set"].tolist(), frame["sig"].tolist(), frame["p"].to_numpy(), frame["q"].to_numpy()
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    out += family(ids[s:e], [np.frombuffer(x, np.uint64) for x in raw[s:e]],
                                  np.frombuffer(b"".join(sig[s:e]), np.uint8).reshape(e - s, -1), tiles[s:e], p[s] != q[s])
            out = pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            yield out[out["a"] != out["b"]]

    return run


def _full_sets(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, plan.shingle) for t in b["text"]]
            yield pd.DataFrame({"fam": b["fam"], "cls": b["cls"], "tiles": b["tiles"], "set": [s.tobytes() for s in sets],
                                "sig": [(signature(s, plan.hashes) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]})

    return run


def _tiled(df: DataFrame, key: str, member: str) -> DataFrame:
    """Give each row its tile out of ``tiles`` and repeat it for every pair (p <= q) that holds the tile."""
    tile = F.pmod(F.xxhash64(F.lit(key), F.col(member)), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    return (df.withColumn("tile", tile).select("*", other)
            .withColumns({"p": F.least("tile", "other"), "q": F.greatest("tile", "other")}).drop("other", "tiles"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``den * |A & B| >= num * |A | B|`` over their shingle sets; ``component_id`` is the
    smallest id reachable over links, ``kept`` marks the row whose id it is.  Null or wordless texts have no
    shingle and are linked with nothing.  Rows of one id count as one document.  A null id is returned with a
    null component and kept.  Other columns are ignored.
    """
    plan = Plan(shingle, num, den, **options)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = staged(rows.mapInPandas(_describe(plan), _SIG_SCHEMA), "dedup-sig")
    named = seen.where("n > 0 and id is not null")
    cls = named.groupBy("d1", "d2").agg(F.min("id").alias("cls"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    cls = staged(cls, "dedup-cls")

    at = cls.select("cls", F.explode("bands").alias("key"))
    busy = at.groupBy("key").count().where("count > 1").withColumn("tiles", F.ceil(F.col("count") / (2 * plan.tile)))
    members = at.join(busy.select("key", "tiles"), "key")
    members = members.join(cls.select("cls", "sig"), "cls")
    dealt = _tiled(members.select("key", "cls", "tiles", "sig"), "bucket", "cls").select("key", "p", "q", "tile", "cls", "sig")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "cls")
    edges = dealt.mapInPandas(_canopies(plan), "a long, b long")
    family = components(edges, "dedup-family").select(F.col("node").alias("cls"), F.col("root").alias("fam"))

    family = staged(family.join(cls.select("cls"), "cls", "leftsemi"), "dedup-fam")
    sizes = (family.join(named.select(F.col("id").alias("cls"), "n"), "cls").groupBy("fam")
             .agg(F.greatest(F.ceil(F.count("*") / plan.tile), F.ceil(F.sum("n") / plan.tile_shingles)).alias("tiles")))
    texts = (rows.withColumnRenamed("id", "cls").join(family.join(sizes, "fam"), "cls").select("fam", "cls", "tiles", "text")
             .mapInPandas(_full_sets(plan), "fam long, cls long, tiles long, set binary, sig binary"))
    dealt = _tiled(texts, "family", "cls").select("fam", "p", "q", "tile", "cls", "set", "sig")
    dealt = dealt.repartition("fam", "p", "q").sortWithinPartitions("fam", "p", "q")
    links = dealt.mapInPandas(_verify(plan), "a long, b long")
    comp = components(links, "dedup-comp")

    out = (seen.join(cls.select("d1", "d2", "cls"), ["d1", "d2"], "left")
           .join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left"))
    # a document without shingles belongs to no class and stands for itself
    component = F.when(F.col("n") > 0, F.coalesce("root", "cls")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), component).alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
