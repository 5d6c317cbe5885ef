"""The block comparison of what lies apart, against brute force, in one block and in many."""

import numpy as np

from sheaf.llm import sketches


def test_blocks_find_every_link(spark, monkeypatch):
    r = np.random.default_rng(9)
    base = [f"w{k}" for k in r.integers(0, 5000, 260)]
    rows = []
    for k in range(70):  # copies around the limit: some linked with the base only, some with one another, some with none
        own = list(base)
        for at in r.integers(0, 260, int(r.integers(4, 40))):
            own[at] = f"x{r.integers(0, 1 << 30)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    group = list(range(70))
    for i in range(70):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group] if group[i] != group[j] else group
    want = {k: min(j for j in range(70) if group[j] == group[k]) for k in range(70)}
    assert len(set(want.values())) > 3
    for turns, nodes in ((2, 1000), (0, 1000), (0, 7)):
        monkeypatch.setattr(sketches, "TURNS", turns)
        monkeypatch.setattr(sketches, "BLOCK_NODES", nodes)
        assert {x["doc_id"]: x["component_id"] for x in sketches.classes(docs).collect()} == want


def test_stage_with_clashing_names_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 7), (1, text, 7), (2, text + " more", 8), (3, None, 9), (4, "", 9), (None, text, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rk int").withColumnRenamed("_rk", "_Many")
    kept = sketches.representatives(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 4]
    assert sketches.representatives(docs.limit(0), 5).count() == 0
