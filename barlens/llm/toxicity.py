"""Toxic passages by maximum-scoring segments of token log-odds.

Training counts, over the distinct texts of a bounded labelled sample, in how many toxic and in how many
clean texts each token and each of its prefixes occurs.  A token's log-odds come from a chain of Dirichlet
priors: the class rates of the whole token are smoothed towards those of its longest prefix, that prefix
towards the next shorter one, down to the base rate; unseen word forms thus inherit from their stem.

A text is then one linear scan: the log-odds, less a drift, are summed into all maximal scoring segments.
Segment scores follow an extreme-value law on clean text, ``P(S >= x) = 1 - exp(-K m exp(-lambda x))`` for m
tokens; lambda and K are fitted on clean training texts, and segments below the significance level are passages.
A text's excess is that of its best segment, ``lambda S - ln(K m)``, or of its best few together by the law of sums of
such scores, and is mapped to a probability.  Calibration scores
each text of the sample by the counts of all others: every unit of a text has counted it once, so its own count is
taken off.  Counts are then as dense as those that score new texts, also in languages with few texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import staged

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: segments of a text that a sum takes at most
_SUMMED = 12
_PASSAGES = "array<struct<start:long,end:long,score:double,p_value:double>>"


@dataclass(frozen=True)
class Plan:
    """sample_rows: expected size of the labelled sample (the bound of the fit).  prior: weight of each Dirichlet
    prior, in texts.  drift: subtracted from every token's log-odds.  least_texts: texts below which a unit is
    left to its prefix.  level: p-value up to which a segment is a toxic passage."""

    sample_rows: int = 20_000
    prior: float = 4.0
    drift: float = 0.75
    least_texts: int = 3
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    level: float = 0.01


def units(token: str, prefixes: tuple[int, ...]) -> list[str]:
    """The chain of a token, shortest prefix first; ``=`` marks the whole token."""
    return [token[:k] for k in prefixes if len(token) > k] + ["=" + token]


@dataclass
class Model:
    plan: Plan
    base: float = 0.0
    table: dict[str, tuple[int, int]] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    u: float = 0.0
    rate: float = 0.0  # 0: every text has the probability ``base``
    most: float = 1.0
    scale: float = 1.0
    odds: float = 0.0
    own: tuple[int, int] = (0, 0)  # toxic and clean counts to take off every unit (a text of the sample scored by the others)
    memo: dict[str, float] = field(default_factory=dict)

    def token_score(self, token: str) -> float:
        s = self.memo.get(token)
        if s is None:
            rate, p = self.base, self.plan
            for u in units(token, p.prefixes):
                got = self.table.get(u)
                if got is None:
                    if u[0] != "=":
                        break  # no longer prefix was seen either
                    continue
                toxic, clean = max(got[0] - self.own[0], 0), max(got[1] - self.own[1], 0)
                if toxic + clean < p.least_texts:  # as if the table did not have it
                    if u[0] != "=":
                        break
                    continue
                rate = (toxic + p.prior * rate) / (toxic + clean + p.prior)
            rate = min(max(rate, 1e-6), 1 - 1e-6)
            s = math.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - p.drift
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[token] = s
        return s

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first token, past the last, score), in order, in one linear scan."""
        memo, low = self.memo, None
        scores = [memo.get(t, low) for t in tokens]
        if None in scores:
            scores = [self.token_score(t) if s is None else s for t, s in zip(tokens, scores, strict=True)]
        a = np.array(scores)
        up = np.flatnonzero(a > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0.0], np.cumsum(a)])
        out: list[list] = []  # first, past, sum before, sum after
        for i in up.tolist():
            seg = [i, i + 1, sums[i], sums[i + 1]]
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][2] >= seg[2]:
                    j = out[j][4]
                if j < 0 or out[j][3] >= seg[3]:
                    out.append([*seg, j])  # j: the nearest earlier segment that starts lower
                    break
                seg = [out[j][0], seg[1], out[j][2], seg[3]]
                del out[j:]
        return [(s[0], s[1], float(s[3] - s[2])) for s in out]

    def excess(self, best: float, m: int) -> float:
        return self.lam * best - self.log_k - math.log(max(m, 1))

    def together(self, scores: list[float], m: int) -> float:
        """The excess of the best segments together: -ln P of the sum t of the r largest, P = exp(-t) t^(r-1) / (r! (r-1)!),
        for the best r, each further one at the price of a factor of two."""
        top, t = self.excess(scores[0] if scores else 0.0, m), 0.0
        for r, s in enumerate(scores[:_SUMMED], 1):
            x = self.excess(s, m)
            if x <= 0:
                break
            t += x
            if r > 1:
                top = max(top, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2.0))
        return top

    def probability(self, x: float) -> float:
        if not self.rate:
            return self.base
        y = min(max(x - self.u, 0.0), 700.0 / self.rate)
        toxic = 0.5 * math.exp(-y / self.scale) / self.scale + (0.5 / self.most)
        odds = self.odds * toxic / (self.rate * math.exp(-self.rate * y))
        return odds / (1.0 + odds) * math.exp(max(self.rate * min(x - self.u, 0.0), -40.0))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        low = (text or "").lower()
        tokens = _TOKEN.findall(low)
        found = self.segments(tokens)
        p = self.probability(self.together(_largest(found), len(tokens)))
        passages = []
        for a, b, s in found:
            x = self.excess(s, len(tokens))
            p_value = -math.expm1(-math.exp(-min(x, 700.0))) if x > -700 else 1.0
            if p_value <= self.plan.level:
                passages.append((a, b, s, p_value))
        if passages:
            at = [(m.start(), m.end()) for m in _TOKEN.finditer(low)]
            if len(low) != len(text):  # a letter whose lower case is longer: map back
                back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
                at = [(back[s], back[e - 1] + 1) for s, e in at]
            passages = [{"start": at[a][0], "end": at[b - 1][1], "score": s, "p_value": v} for a, b, s, v in passages]
        return p, passages


def labelled_sample(docs: DataFrame, labels: DataFrame, plan: Plan, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of about ``sample_rows`` labelled rows, chosen by a hash of the id; the broadcast is bounded by it."""
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    lab = lab.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = lab.count()
    share = min(1.0, plan.sample_rows / max(n, 1))
    return lab.where(F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the given labelled rows.  Without rows of both classes every score is the toxic share."""
    sample = labelled_sample(docs, labels, plan, id_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(F.broadcast(sample), "id").withColumn("h", F.xxhash64("text"))
    # copies count once: their rare words would else look like evidence
    first = staged(texts.groupBy("h").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")), "toxic-sample")
    texts = rows.join(F.broadcast(first.select("id", "toxic")), "id").dropDuplicates(["id"])
    texts = staged(texts, "toxic-texts")  # bounded by sample_rows
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, every = size.get(1, 0), sum(size.values())
    model = Model(plan, base=toxic / every if every else 0.0)
    if not 0 < toxic < every:
        return _flat(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, t in zip(b["text"], b["toxic"], strict=True):
                have = {u for w in set(_TOKEN.findall((text or "").lower())) for u in units(w, plan.prefixes)}
                for u in have:
                    seen.setdefault(u, [0, 0])[1 - t] += 1
            if len(seen) > 500_000:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)

    counts = (texts.select("text", "toxic").mapInPandas(count, "unit string, toxic long, clean long")
              .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic + clean >= {plan.least_texts}"))
    pdf = counts.toPandas()  # bounded by the sample's vocabulary
    model.table = {u: (t, c) for u, t, c in zip(pdf["unit"].tolist(), pdf["toxic"].tolist(), pdf["clean"].tolist(), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, table = shared.value.base, shared.value.table
        by_others = [Model(plan, base, table, own=own) for own in ((0, 1), (1, 0))]
        for b in batches:
            out = []
            for text, t in zip(b["text"], b["toxic"], strict=True):
                tokens = _TOKEN.findall((text or "").lower())
                out.append((t, len(tokens), _largest(by_others[t].segments(tokens))))
            yield pd.DataFrame(out, columns=["toxic", "m", "scores"])

    got = texts.select("text", "toxic").mapInPandas(others, "toxic int, m long, scores array<double>").toPandas()  # a few numbers per sampled text
    return _calibrate(model, got)


def _largest(found: list[tuple[int, int, float]]) -> list[float]:
    return sorted((s for *_, s in found), reverse=True)[:_SUMMED]


def _counts(seen: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(u, *c) for u, c in seen.items()], columns=["unit", "toxic", "clean"])


def _flat(model: Model) -> Model:
    model.base, model.rate = min(max(model.base, 1e-6), 1 - 1e-6), 0.0
    return model


def _calibrate(model: Model, got: pd.DataFrame) -> Model:
    """lambda and K by maximum likelihood of the extreme-value law over the clean texts' best segments; then the
    probability of the label given the excess, from at most ``sample_rows`` numbers."""
    got = got.assign(best=[max(s, default=0.0) for s in got["scores"]])
    clean = got[(got["toxic"] == 0) & (got["m"] > 0)]
    s, m = clean["best"].to_numpy(), clean["m"].to_numpy(float)

    def loglik(lam: float) -> tuple[float, float]:
        # given lambda, K = n / sum(m exp(-lambda s)) maximises the likelihood
        k = len(s) / np.sum(m * np.exp(-lam * s))
        return len(s) * math.log(lam) + np.sum(np.log(k * m) - lam * s) - k * np.sum(m * np.exp(-lam * s)), k

    grid = np.exp(np.linspace(math.log(0.05), math.log(5.0), 60))
    model.lam = float(max(grid, key=lambda v: loglik(v)[0])) if len(s) else 1.0
    model.log_k = math.log(loglik(model.lam)[1]) if len(s) else 0.0
    x = np.array([model.together(list(s), m) for s, m in zip(got["scores"], got["m"], strict=True)])
    y = got["toxic"].to_numpy(int)
    return _posterior(model, x[y == 0], x[y == 1])


def _posterior(model: Model, clean: np.ndarray, toxic: np.ndarray) -> Model:
    """Bayes' rule on the excess, from the clean texts' tail.  Beyond its 90th percentile ``u`` the clean excess falls off
    exponentially (the law of exceedances, its rate from their median, which a few mislabelled texts do not move).  Toxic excesses, which differ widely between
    languages and are low where words are rare, get a wide density over the same range: half exponential with their
    median, half even up to the largest.  Below ``u`` the probability falls off with the excess."""
    u = float(np.quantile(clean, 0.9))
    over, hits = clean[clean > u] - u, toxic[toxic > u] - u
    if len(over) < 5 or len(hits) < 2 or not hits.max() > 0:
        return _flat(model)
    model.u, model.rate = u, math.log(2.0) / max(float(np.median(over)), 1e-6)
    model.most, model.scale = float(hits.max()), max(float(np.median(hits)) / math.log(2.0), 1e-6)
    model.odds = model.base * len(hits) / len(toxic) / ((1.0 - model.base) * len(over) / len(clean))
    return model


def score_column(model: Model, spark):
    """A column function text -> struct(score, passages); the model goes out as one broadcast bounded by its sample."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, passages {_PASSAGES}")
    def run(text: pd.Series) -> pd.DataFrame:
        got = [shared.value.score(t) for t in text]
        return pd.DataFrame({"score": [g[0] for g in got], "passages": [g[1] for g in got]})

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` per input row: the probability that the text is labelled toxic, and its
    significant toxic passages (code points, end exclusive).  Null and empty texts have no token: their score
    is that of an empty segment.  A null id is carried along; other columns are ignored."""
    run = score_column(model, docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("r"))
            .select("doc_id", "r.score", "r.passages"))
