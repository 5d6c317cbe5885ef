"""Decontamination against brute force, and on passages in which words were replaced."""

import numpy as np
import pytest

from sheaf.llm import latent


def words_of(r, n, vocabulary=4000):
    ranks = np.exp(r.uniform(0, np.log(vocabulary), n)).astype(int)
    return [f"w{k}x" for k in ranks]


@pytest.fixture(scope="module")
def planted():
    """Items, and documents of which each holds an item with a share of its words replaced."""
    r = np.random.default_rng(12)
    items = [words_of(r, int(n)) for n in r.integers(25, 60, 30)]
    docs, truth = [words_of(r, int(n)) for n in r.integers(5, 400, 200)], []
    for share in (0.0, 0.1, 0.2, 0.3):
        for k, item in enumerate(items):
            text = [w if r.random() >= share else words_of(r, 1)[0] for w in item]
            around = words_of(r, 150)
            at = int(r.integers(150))
            truth.append((len(docs), k, share))
            docs.append(around[:at] + text + around[at:])
    return items, docs, truth


def test_recall_of_replaced_words(spark, planted):
    items, docs, truth = planted
    table = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(table, bench).collect()}
    for share in (0.0, 0.1, 0.2, 0.3):
        own = [(d, i) for d, i, s in truth if s == share]
        assert np.mean([x in got for x in own]) >= 0.9, share
    assert len(got - {(d, i) for d, i, _ in truth}) <= 2

    # brute force: the share of an item's words in order within the widest stretch that a window can show
    def best(item, doc):
        width = latent.width_of(len(item)) * 3 // 2
        return max(_lcs(item, doc[s : s + width]) for s in range(0, max(1, len(doc) - width + 1), 5)) / len(item)

    sample = [(d, i) for d in range(0, 200, 20) for i in range(0, 30, 6)] + [(d, i) for d, i, _ in truth[::10]]
    for d, i in sample:
        share = best(items[i], docs[d])
        assert share >= latent.PARAPHRASE - 0.06 or (d, i) not in got
        assert share < latent.COPY + 0.06 or (d, i) in got, (d, i, share)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_cosine_makes_the_candidates(spark, planted, monkeypatch):
    items, docs, _ = planted
    table = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs[-20:])], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    assert latent.contaminated(table, bench).count() >= 18
    monkeypatch.setattr(latent, "CANDIDATE", 1.01)
    assert latent.contaminated(table, bench).count() == 0


def test_edges(spark):
    r = np.random.default_rng(3)
    item = " ".join(words_of(r, 30))
    long = " ".join(words_of(r, 70_000) + item.split() + words_of(r, 3000))
    docs = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, item, 5), (2, None, 5), (3, "", 5), (4, long, 5), (5, "w1x", 5)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(None, item, "a"), (7, item, "b"), (8, None, "c"), (9, "...", "d"), (10, " ".join(words_of(r, 2500)), "e")], "item_id long, text string, doc_id string")
    got = sorted(((x["doc_id"], x["item_id"]) for x in latent.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None, 4) for i in (None, 7)], key=str)
    blocks = sorted(((x["doc_id"], x["item_id"]) for x in latent.contaminated(docs, bench, block_items=2).collect()), key=str)
    assert blocks == got
    clashing = docs.withColumnRenamed("item_id", "_rk")
    kept = latent.clean_of(clashing, bench)
    assert kept.columns == clashing.columns and sorted(tuple(x) for x in kept.select("doc_id", "_rk").collect()) == [(2, 5), (3, 5), (5, 5)]
