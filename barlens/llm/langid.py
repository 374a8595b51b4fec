"""Language identification by compression: a text is encoded with one zstandard raw-content dictionary per
language; the language whose dictionary leaves the fewest bytes wins, and narrow margins are rejected.

Long texts are encoded in blocks, so that every block is helped by the dictionary alone and evidence adds up
over the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Plan:
    """rows_per_lang: expected rows sampled per language for its dictionary (the bound of the fit).  dict_bytes:
    most bytes of a dictionary; all languages get the same size.  block: bytes encoded at a time.  level:
    zstandard level.  beta: log-odds per byte of difference.  margin: least relative gap between the best and
    the second language for a prediction to be accepted."""

    rows_per_lang: int = 300
    dict_bytes: int = 131_072
    least_dict: int = 16_384
    block: int = 8_192
    level: int = 9
    beta: float = 0.25
    margin: float = 0.02


def letters(text: str | None) -> str:
    """Lower-case letters of the text, everything between words one space."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


@dataclass
class Model:
    plan: Plan
    dictionaries: dict[str, bytes]
    _coders: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"plan": self.plan, "dictionaries": self.dictionaries, "_coders": {}}

    def sizes(self, text: str) -> list[tuple[int, str]]:
        if not self._coders:
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.plan.level)
                self._coders[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode("utf-8", "surrogatepass")
        blocks = [raw[i:i + self.plan.block] for i in range(0, len(raw), self.plan.block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self._coders.items())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und`` for a text without a letter or a model without languages."""
        clean = letters(text)
        if not self.dictionaries or not _LETTER.search(clean):
            return "und", 0.0, False
        got = self.sizes(f" {clean} ")
        best = got[0][0]
        if len(got) > 1 and got[1][0] == best:  # a few words: the dictionaries that hold more of them verbatim
            words = [f" {w} ".encode("utf-8", "surrogatepass") for w in clean.split()]
            held = {lang: sum(len(w) for w in words if w in self.dictionaries[lang]) for s, lang in got if s == best}
            got.sort(key=lambda g: (g[0], -held.get(g[1], 0), g[1]))
        score = 1.0 / sum(math.exp(-min(50.0, self.plan.beta * (s - best))) for s, _ in got)
        second = got[1][0] if len(got) > 1 else math.inf
        return got[0][1], score, second - best >= self.plan.margin * best


def fit(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """One dictionary per non-null language, from whole sampled texts in hash order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().collect()  # one row per language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, plan.rows_per_lang / r["count"]))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(u < share).select("lang", "text", u.alias("u")).toPandas()
    have = {}
    for lang, part in sample.sort_values(["lang", "u", "text"]).drop_duplicates(["lang", "text"]).groupby("lang"):
        have[lang] = [letters(t).encode("utf-8", "surrogatepass") for t in part["text"]]
    size = min(plan.dict_bytes, max(plan.least_dict, min((sum(map(len, t)) for t in have.values()), default=0)))
    dictionaries = {}
    for lang, texts in sorted(have.items()):
        # short texts first within the sample order: many documents speak for the language, not one
        parts, left = [], size
        for raw in sorted(texts, key=len):
            if left <= 0:
                break
            parts.append(raw[:left])
            left -= len(raw) + 1
        dictionaries[lang] = b" ".join(reversed(parts))
    return Model(plan, dictionaries)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, score, accepted`` per input row.  Null, empty and letterless texts are ``und`` with score
    0; equally small languages go to the one whose
    dictionary holds more of the words, then to the first by name.  Null ids are carried; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shared.value.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] for g in got]})

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInPandas(run, "doc_id long, lang string, score double, accepted boolean"))
