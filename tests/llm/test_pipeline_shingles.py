"""The near-duplicate stage against brute force over shingles of five words."""

import re

import corpus_pipeline
import numpy as np


def test_stage_keeps_what_differs_in_five_words(spark):
    r = np.random.default_rng(11)
    words = lambda n: ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(n)]
    short, long, near = words(30), words(500), words(200)
    texts = [short, [w if k != 15 else "other" for k, w in enumerate(short)], long, [w if k % 25 else "other" for k, w in enumerate(long)], near, [*near, "more"], near[:4], near[:4], None, None]
    rows = [(k, None if t is None else " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long")

    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    sets = {k: shingles(t) for k, t, *_ in rows}
    want = [k for k in sets if not sets[k] or not any(sets[j] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) for j in range(k))]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want == [0, 1, 2, 3, 4, 6, 8, 9]
