"""Bins that are too large for one scan: the same stretches as window by window, in far fewer rows."""

import numpy as np

from sheaf.llm import suffixes
from sheaf.llm.repeats import binned, counted_windows, keyed, read_contexts, repeated_anchors


def test_stretches_of_large_bins(spark):
    r = np.random.default_rng(4)
    letters = lambda k: "".join(chr(97 + c) for c in r.integers(0, 26, k))
    line = letters(280)
    texts = [(k, letters(90) + line[: 215 + k // 2] + letters(60)) for k in range(120)]
    rows = keyed(spark.createDataFrame(texts, "doc_id long, text string"))
    contexts = read_contexts(rows, repeated_anchors(rows, suffixes.SCHEME), suffixes.SCHEME)
    bins = binned(contexts, suffixes.SCHEME)
    large = bins.withColumnRenamed("n", "nu").join(contexts.select("a", "c", "left", "ctx"), ["a", "c"])
    got = counted_windows(large, contexts, suffixes.SCHEME).collect()

    held = {(x["a"], x["c"]): (bytes(x["ctx"]), x["left"]) for x in contexts.collect()}
    places, told, want = {}, set(), set()
    for key, (ctx, left) in held.items():
        for s in range(len(ctx) - 199):
            places.setdefault((key[0], s - left, ctx[s : s + 200]), []).append(key)
    for (_, d, _), keys in places.items():
        if len(keys) > 1 and d > -suffixes.SCHEME.span:
            want |= {(key, d) for key in keys}
    for x in got:
        told |= {((x["a"], x["c"]), d) for d in range(x["low"], x["high"] - 199)}
    cover = lambda windows: {(key, p) for key, d in windows for p in range(d, d + 200)}
    assert len(want) > 2000 and cover(told) == cover(want)
    assert len(got) * 4 < len(want)


def test_equal_parts_of_a_bin_are_looked_at_once(spark, monkeypatch):
    """A group of many contexts that differ far from a bin is no large bin; the stretches stay those of brute force."""
    r = np.random.default_rng(6)
    letters = lambda k: "".join(chr(97 + c) for c in r.integers(0, 26, k))
    heads, line, tails = [letters(30) for _ in range(4)], letters(300), [letters(30) for _ in range(4)]
    texts = [letters(60) + heads[k % 4] + line + tails[k // 4 % 4] + letters(20 + k) for k in range(96)]
    texts += [texts[0], texts[5]]
    texts += [letters(50) + line[k : 215 + k] + letters(50) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    handed, dealt, resolve = [], [], suffixes.resolve
    monkeypatch.setattr(suffixes, "resolve", lambda unclear, *rest: handed.append(unclear.count()) or resolve(unclear, *rest))
    monkeypatch.setattr(suffixes, "binned", lambda *given: dealt.append(bins := binned(*given)) or bins)
    places, want = {}, [set() for _ in texts]
    for k, t in enumerate(texts):
        for s in range(len(t) - 199):
            places.setdefault(t[s : s + 200], []).append((k, s))
    for own in places.values():
        for k, s in own if len(own) > 1 else ():
            want[k].update(range(s, s + 200))
    for members in (4096, 3):
        rows, marked = suffixes.repeated_spans(docs, 4, members)
        got = [set() for _ in texts]
        for x in marked.join(rows.select("rk", "doc_id"), "rk").collect():
            for mark in x["marks"]:
                for low, high in mark["own"]:
                    got[x["doc_id"]].update(range(max(0, mark["pos"] + low), min(len(texts[x["doc_id"]]), mark["pos"] + high)))
        assert got == want
    assert all(n < 0.9 * bins.count() for n, bins in zip(handed, dealt, strict=True)), handed
