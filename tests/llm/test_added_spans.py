"""Spans that the network adds: recall and precision on texts that training doesn't see."""

import time

import numpy as np

from sheaf.llm import pii

AROUND = "renn tole uder the minas of atha, beld orine. sut kell on thate uren and wole dorin".split()


def measured(n=600, seed=999):
    w, tagger = pii._Writer(seed), pii.trained()
    wanted, found, false = np.zeros(4), np.zeros(4), 0
    for k in range(n):
        kind = k % 4
        span = (w.email, w.ip, w.card, w.phone)[kind]()
        before = " ".join(w.pick(AROUND) for _ in range(12)) + " "
        text = before + span + " " + " ".join(w.pick(AROUND) for _ in range(12)) + " " + w.other() + " end"
        s, e = len(before), len(before) + len(span)
        base, every = pii.all_spans(text, tagger)
        if (s, kind, e) in base:
            continue
        added = [x for x in every if x not in base]
        wanted[kind] += 1
        found[kind] += any(q == kind and min(b, e) - max(a, s) >= 0.8 * (e - s) for a, q, b in added)
        false += sum(b <= s or a >= e for a, _, b in added)
    return wanted, found, false


def test_recall_and_precision_beyond_the_patterns():
    wanted, found, false = measured()
    assert wanted.sum() > 200 and (found / wanted > 0.75).all() and found.sum() / wanted.sum() > 0.85
    assert found.sum() / (found.sum() + false) > 0.95


def test_spellings_and_look_alikes():
    tagger = pii.trained()
    for text, kind in (("call 974-555-3436 now", 3), ("ring (212) 555-0101 please", 3), ("ask jo[at]ex[dot]org", 0), ("host 10[.]1[.]22[.]3 down", 1)):
        base, every = pii.all_spans(text, tagger)
        assert base == [] and [k for _, k, _ in every] == [kind], text
    assert [text[s:e] for text in ["ring (212) 555-0101 please"] for s, _, e in pii.all_spans(text, tagger)[1]] == ["(212) 555-0101"]
    for text in ("12 345 678 900 units", "ISBN 978 0 306 40615 7", "2024-01-02 03:04:05", "from 10.0.0.300 host"):
        assert pii.all_spans(text, tagger)[1] == [], text


def test_long_runs_of_digits_take_linear_time():
    began = time.perf_counter()
    assert pii.base_spans("1" * 1_000_000) == [] and pii.base_spans("1.1.1." * 100_000)
    assert time.perf_counter() - began < 5


def plain_path(text, tagger):
    """The best path of the whole text, from the scores of all its windows."""
    n = max(0, -(-(len(text) - pii.WINDOW) // pii.STRIDE)) + 1
    symbols, total, weight = np.full((n + 1) * pii.STRIDE, pii.PAD, np.int8), np.zeros(((n + 1) * pii.STRIDE, 9)), np.zeros(((n + 1) * pii.STRIDE, 1))
    symbols[: len(text)] = pii.symbols(text)
    starts = [k * pii.STRIDE for k in range(n)]
    for s, scores in zip(starts, tagger.emissions(np.stack([symbols[s : s + pii.WINDOW] for s in starts])), strict=True):
        total[s : s + pii.WINDOW] += scores * pii._WEIGHT[:, None]
        weight[s : s + pii.WINDOW] += pii._WEIGHT[:, None]
    return tagger.decode((total / weight)[: len(text)]).tolist()


def test_every_window_is_looked_at():
    """Spellings without a digit, an at sign or a bracketed at, alone, far from anything else, and across block edges."""
    tagger = pii.trained()
    for text in ("write to jo at example.org or call", "jo at ex[dot]org please answer", "renn tole uder " * 40 + "jo at example.org" + " sut kell on thate" * 40):
        assert [(text[s:e].count(" at ") or "[dot]" in text[s:e], k) for s, k, e in pii.all_spans(text, tagger)[1]] == [(1, 0)], text
    w = pii._Writer(31)
    texts = ["", "a"]
    for _ in range(60):
        parts = [w.pick((w.word, w.word, w.word, w.other, w.email, w.ip, w.card, w.phone))() for _ in range(int(w.r.integers(1, 150)))]
        texts.append(w.pick((" ", ", ", ". ")).join(parts))
    holds = lambda text, s, e: e - s >= pii._LEAST and pii._NEEDED.search(text, s, e)
    want = [[x for x in pii._spans_of(plain_path(t, tagger), 0) if holds(t, x[0], x[2])] if t else [] for t in texts]
    assert sum(map(len, want)) > 500
    for block in (1024, 3):
        assert [[x for x in own if holds(t, x[0], x[2])] for t, own in zip(texts, pii.tagged_spans(texts, tagger, block), strict=True)] == want


def test_prose_costs_few_windows_and_no_span(monkeypatch):
    """Only what can hold a span is scored, and the spans are those of the whole text's paths."""
    tagger, w, run = pii.trained(), pii._Writer(41), []
    scored = type(tagger).scored
    monkeypatch.setattr(type(tagger), "scored", lambda self, ids: run.append(len(ids)) or scored(self, ids))
    prose = "renn tole uder the minas of atha, beld orine. sut kell on thate uren and wole dorin " * 40
    texts = [prose + "write to jo at example.org or call 974-555-3436 now " + prose, prose + "mail jo@example.org, born 2024-01-02 " + prose, "at", "974-555-3436"]
    for _ in range(60):
        parts = [w.pick((w.word,) * 12 + (w.other, w.email, w.ip, w.card, w.phone))() for _ in range(int(w.r.integers(1, 200)))]
        texts.append(w.pick((" ", ", ", ". ", "")).join(parts))
    assert [len(every) - len(base) for base, every in pii.spans_of_texts(texts[:2], tagger)] == [2, 0]
    assert sum(run) < 0.1 * sum(len(t) / pii.STRIDE for t in texts[:2])
    for text, (base, every) in zip(texts, pii.spans_of_texts(texts, tagger), strict=True):
        want = list(base)
        for s, k, e in pii._spans_of(plain_path(text, tagger), 0):
            s, e = pii._trimmed(text, s, e)
            if s < e and pii._substance(k, text[s:e]) and all(e <= b or s >= c for b, _, c in base):
                want.append((s, k, e))
        assert every == sorted(want)
