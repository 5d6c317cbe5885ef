"""Each stage of the corpus pipeline against a plain version, with nulls, ties, repeated rows and clashing columns."""

import zlib

import corpus_pipeline
import numpy as np
import pytest

from sheaf.llm import latent, pii, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _rk int, _One string, score double"


def words(r, n):
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, int(k))) for k in r.integers(2, 9, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    item = words(r, 40)
    texts = [(k, words(r, int(r.integers(40, 160))) + ".") for k in range(60)]
    texts += [(100 + k, (words(r, 40) + "!!! ### ").upper() * 2) for k in range(40)]
    texts += [(200, texts[0][1] + " more"), (201, words(r, 30) + " " + item + " " + words(r, 30)), (202, "mail a.b@c.de or +1 (555) 123-4567 " + words(r, 50)), (203, None), (204, ""), (205, words(r, 5000)), (None, words(r, 50)), (1, texts[1][1])]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in texts]
    path = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100)) for k in [*range(60), *range(100, 140)]] + [(None, 1), (5, 7)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return str(path)


def plain_discriminant(rows, labels):
    """Scores of all rows by numpy alone."""
    train = [(quality.statistics(t), y) for i, t in rows for j, y in labels if i is not None and i == j and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([a for a, _ in train]), np.array([b for _, b in train])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    share = [np.mean(y == c) for c in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    every, logs = np.array([quality.statistics(t) for _, t in rows]), []
    for c in (0, 1):
        covariance = 0.8 * own[c] + 0.2 * pooled + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        z = every - x[y == c].mean(0)
        logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(covariance), z))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_quality_against_numpy(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_discriminant(rows, [tuple(r) for r in labels.collect()])
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.quality(docs, labels).collect())
    assert [k for k, _ in got] == sorted(str(i) for i, _ in rows)
    assert np.allclose([s for _, s in got], [s for _, s in sorted((str(i), s) for (i, _), s in zip(rows, want, strict=True))], atol=1e-6)
    kept = corpus_pipeline.reject_low_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for (i, _), s in zip(rows, want, strict=True) if s >= 0.7)
    one = labels.where("quality = 0")
    assert {r["score"] for r in quality.quality(docs, one).collect()} == {0.0} and quality.accepted(docs, one).count() == 0
    assert {r["score"] for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_leaks_and_personal_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.remove_benchmark_leaks(spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] != 201)
    redacted = corpus_pipeline.redact_personal_data(spark, docs, folder)
    tagger = pii.trained()
    want = sorted((str(r["doc_id"]), r["text"] if r["text"] is None else pii.redacted(r["text"], pii.all_spans(r["text"], tagger)[1])) for r in docs.collect())
    got = redacted.collect()
    assert redacted.columns == docs.columns and sorted(((str(r["doc_id"]), r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert "[EMAIL]" in next(r["text"] for r in got if r["doc_id"] == 202)


def test_run_and_empty_tables(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    rows = packed.collect()
    ids = {r["doc_id"] for r in rows}
    assert 201 not in ids and 200 not in ids and 0 in ids and not ids & set(range(100, 140))
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_redaction_looks_at_every_window(spark):
    """Texts without a digit, an at sign or a bracketed at are run through the network too."""
    docs = spark.createDataFrame([(1, "write to jo at example.org or call", 34), (2, None, 0), (3, "", 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_personal_data(spark, docs, "").collect()}
    assert "[EMAIL]" in got[1] and "example.org" not in got[1] and got[2] is None and got[3] == ""
