"""Secret scan with DataFrame functions only.

Pattern matches get their positions from ``split``: the pieces between the matches and the matches themselves
alternate, so running sums of their lengths are the spans.  Candidate strings (long runs of key characters that
hold a digit and a letter) are read by a sliding window whose character counts are updated by one character in
and one out; ``sum c log2 c`` is kept alongside, and with it the window's Shannon entropy.  Windows at or above
the threshold of their character class are merged into spans: the class of the piece between separators that holds
the window, or the candidate's.  Candidates that an anchored allow-list pattern matches as a whole are suppressed; a
placeholder inside a candidate cuts it in two, and each rest is a candidate of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the base patterns: kind, pattern, group whose length counts, least length
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: allow-list: patterns from ^ to $ suppress the whole candidate (UUIDs), others only what they match (placeholders)
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|xxxx|0000|1234",
)
#: a piece of an allow-listed path: a plain word, perhaps numbered, or a short number
_PIECE = r"^([A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4})$"
_ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"


@dataclass(frozen=True)
class Plan:
    """window: characters per entropy window, also the least candidate length.  classes: name, pattern of the
    whole piece or candidate, least entropy in bits; the first class that fits counts."""

    window: int = 20
    classes: tuple[tuple[str, str, float], ...] = (("hex", "^[0-9a-fA-F]+$", 3.0), ("base64", "^[A-Za-z0-9+/_=-]+$", 3.75))
    allow: Sequence[str] = ALLOW


def _spans(text: Column, kind: str, no: int, pattern: str, group: int, least: int, block: int = 256) -> Column:
    """array<struct<start, no, end, kind>> of the pattern's matches whose ``group`` has ``least`` characters.

    The running sum of lengths goes over blocks of matches, then within each block: appending to one array a match
    would cost the square of their number."""
    found = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("key"))
    kept = "array<struct<start:bigint,no:int,end:bigint,kind:string,key:string>>"
    length = lambda m: (F.length(m["gap"]) + F.length(m["all"])).cast("bigint")

    def blocks(all_):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda k: F.slice(all_, k * block + 1, block))
        return F.transform(cut, lambda ms: F.struct(ms.alias("ms"), F.aggregate(ms, F.lit(0).cast("bigint"), lambda n, m: n + length(m)).alias("n")))

    def ahead(bs):
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(bs, begin, lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    def step(acc, m):
        s = acc["at"] + F.length(m["gap"])
        e = s + F.length(m["all"])
        one = F.struct(s.alias("start"), F.lit(no).alias("no"), e.alias("end"), F.lit(kind).alias("kind"), m["key"].alias("key"))
        return F.struct(e.alias("at"), F.when(F.length(m["key"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def inside(b, at):
        return F.aggregate(b["ms"], F.struct(at.alias("at"), F.array().cast(kept).alias("out")), step, lambda acc: acc["out"])

    # a lambda's argument is evaluated once, so one-element arrays keep what several places read
    spans = F.transform(F.transform(F.array(found), blocks), lambda bs: F.flatten(F.zip_with(bs, ahead(bs), inside)))[0]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kept))


def _mixed(key: Column) -> Column:
    return key.rlike("[0-9]") & key.rlike("[A-Za-z]")


def _bits(key: Column, plan: Plan, least: Column) -> Column:
    for _, pattern, bits in reversed(plan.classes):
        least = F.when(key.rlike(pattern), F.lit(bits)).otherwise(least)
    return least


def _windows(key: Column, plan: Plan) -> Column:
    """array<struct<s, e>> of the merged windows of ``key`` (offsets in it) that reach their class's entropy.

    The state carries the window's characters and the candidate's threshold, so a step costs the window and the
    alphabet, however long the candidate is.  A window inside one piece that holds a digit and a letter goes by the
    piece's class."""
    w, size = plan.window, len(_ALPHABET)
    least = _bits(key, plan, F.lit(math.inf))
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 1)])
    weight = lambda c: F.element_at(clogc, c + 1)
    begin = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), w).alias("ring"), F.array_repeat(F.lit(0), size).alias("n"),
                     F.lit(0.0).alias("sum"), least.alias("least"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, char):
        i, new = acc["i"] + 1, char["place"]
        old = F.element_at(acc["ring"], 1)  # 0 until the window is full
        # the character that leaves, then the one that enters
        c_old = F.when(old > 0, F.element_at(acc["n"], F.greatest(old, F.lit(1))))
        less = F.when(old > 0, weight(c_old - 1) - weight(c_old)).otherwise(F.lit(0.0))
        c_new = F.element_at(acc["n"], new) - F.when(old == new, 1).otherwise(0)
        total = acc["sum"] + less + weight(c_new + 1) - weight(c_new)
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0))
        ring = F.concat(F.slice(acc["ring"], 2, w - 1), F.array(new))
        last = F.try_element_at(acc["out"], F.lit(-1))
        hit = (i >= w) & (F.lit(math.log2(w)) - total / w >= F.coalesce(char["least"], acc["least"]))
        fresh = F.array(F.struct((i - w).alias("s"), i.alias("e")))
        joined = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), i.alias("e"))))
        out = F.when(~hit, acc["out"]).when(F.coalesce(last["e"] >= i - w, F.lit(False)), joined).otherwise(F.concat(acc["out"], fresh))
        return F.struct(i.alias("i"), ring.alias("ring"), counts.alias("n"), total.alias("sum"), acc["least"].alias("least"), out.alias("out"))

    none = F.lit(None).cast("double")
    pieces = F.transform(F.regexp_extract_all(key, F.lit("[^-_/=]+|[-_/=]"), F.lit(0)),
                         lambda p: F.struct(p.alias("p"), F.when((F.length(p) >= w) & _mixed(p), _bits(p, plan, none)).alias("least")))
    chars = F.flatten(F.transform(pieces, lambda x: F.transform(F.filter(F.split(x["p"], ""), lambda c: c != ""), lambda c, k: F.struct(
        F.position(c, F.lit(_ALPHABET)).alias("place"), F.when(k + 1 >= w, x["least"]).alias("least")))))
    return F.aggregate(chars, begin, step, lambda acc: acc["out"])


def _path(key: Column) -> Column:
    """Whether ``key`` is two or more plain pieces between separators, one more separator at its end allowed.  Read
    piece by piece: a repeated group would take a stack frame a piece."""
    pieces = F.split(F.regexp_replace(key, "[-_/=]$", ""), "[-_/=]", -1)
    return (F.size(pieces) > 1) & F.forall(pieces, lambda p: p.rlike(_PIECE))


def scan(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``, one row per input row: arrays of struct<start, no, end, kind> in code points, end
    exclusive, ordered by start, then kind.  ``base`` are the pattern matches, ``added`` the entropy spans (kind
    ``entropy``) that no base span covers.  Null and empty texts have none.  Null ids are carried along."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.withColumns({kind: _spans(F.col("t"), kind, no, pattern, group, least) for no, (kind, pattern, group, least) in enumerate(BASE)})
    run = "A-Za-z0-9+/_=-"
    rows = rows.withColumn("runs", _spans(F.col("t"), "entropy", len(BASE), f"(?<![{run}])[{run}]{{{plan.window},}}+", 0, plan.window))

    whole = [p for p in plan.allow if re.match(r"(\(\?\w+\))?\^", p) and p.endswith("$")]
    inside = "|".join(f"(?:{p})" for p in plan.allow if p not in whole)

    def rests(r: Column) -> Column:
        """What the placeholders leave of a run, as runs of their own."""
        if not inside:
            return F.array(r)

        def cut(hits):
            begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(hits, lambda h: h["end"]))
            ends = F.concat(F.transform(hits, lambda h: h["start"]), F.array(F.length(r["key"]).cast("bigint")))
            parts = F.filter(F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["e"] - x["s"] >= plan.window)
            return F.transform(parts, lambda x: F.struct((r["start"] + x["s"]).alias("start"), r["no"].alias("no"), (r["start"] + x["e"]).alias("end"),
                                                         r["kind"].alias("kind"), F.substring(r["key"], x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int")).alias("key")))

        cuts = F.transform(F.array(_spans(r["key"], "allow", 0, inside, 0, 0)), cut)[0]
        return F.when(r["key"].rlike(inside), F.filter(cuts, lambda x: ~_path(F.regexp_replace(x["key"], "^[-_/=]", "")))).otherwise(F.array(r))

    def candidate(r: Column) -> Column:
        ok = _mixed(r["key"]) & ~_path(r["key"])
        for pattern in whole:
            ok = ok & ~r["key"].rlike(pattern)
        return ok

    flat = lambda r: F.struct(r["start"].alias("start"), r["no"].alias("no"), r["end"].alias("end"), r["kind"].alias("kind"))
    rows = rows.select("doc_id", F.transform(F.array_sort(F.concat(*[F.col(k) for k, *_ in BASE])), flat).alias("base"), F.flatten(F.transform(F.filter("runs", candidate), rests)).alias("runs"))
    rows = rows.withColumn("runs", F.filter("runs", lambda r: _mixed(r["key"])))
    added = F.flatten(F.transform("runs", lambda r: F.transform(_windows(r["key"], plan), lambda x: F.struct(
        (r["start"] + x["s"]).alias("start"), r["no"].alias("no"), (r["start"] + x["e"]).alias("end"), r["kind"].alias("kind")))))
    added = F.when(F.size("runs") > 0, added).otherwise(F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>"))
    rows = rows.select("doc_id", "base", added.alias("added"))
    return rows.withColumn("added", F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"]))))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans by start, then kind, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
