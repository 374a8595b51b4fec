"""The edges of a large bucket of near copies grow with its members, not with its pairs of tiles."""

import random

from barlens.llm import near_dedup


def test_edges_of_a_bucket_do_not_grow_with_its_tiles(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):  # distinct texts, three words changed in each
        words = list(base)
        for k in rng.sample(range(400), 3):
            words[k] = f"x{i}_{k}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"lone{i}_{k}" for k in range(50))) for i in range(20)]
    counts, real = {}, near_dedup.components

    def counted(edges, name):
        counts[name] = edges.distinct().count()
        return real(edges, name)

    monkeypatch.setattr(near_dedup, "components", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    whole = near_dedup.near_duplicates(docs).collect()
    out = near_dedup.near_duplicates(docs, tile=4).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, whole))
    assert {r["component_id"] for r in out if r["doc_id"] <= 1000} == {851}
    assert all(r["component_id"] == r["doc_id"] for r in out if r["doc_id"] >= 2000)
    assert counts["dedup-family"] <= 2500  # 3748 when every pair of tiles linked its members
