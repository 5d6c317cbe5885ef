"""Text functions, scores and chunkers against plain Python."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.functions import scoring, text
from sheaf.operators import chunking

SAMPLES = ["", " ", "a", "ＡＢＣ　ｄｅｆ", "Straße 3.5 です。次の文！\n- 項目\n# 見出し\n1. two", "ー。、x", "😀😀 b", "The quick (brown) fox.", "a b　c", "x" * 30, "A-B_c\\|d"]


def column(spark, expression, values=SAMPLES):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r["o"] for r in rows.select("k", expression(F.col("t")).alias("o")).orderBy("k").collect()]


def t7(s):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s))


def t8(s):
    return re.sub(text.ANSWER_PUNCTUATION, "", t7(s)).lower().replace("ß", "ss")


def test_normal_forms(spark):
    assert column(spark, text.normalize_for_match) == [t7(s) for s in SAMPLES]
    assert column(spark, text.normalize_answer) == [t8(s) for s in SAMPLES]


def test_grams(spark):
    def t1(s, n=2):
        out = []
        for seg in unicodedata.normalize("NFKC", s).lower().split():
            if not re.match(text.TOKEN_NOISE, seg):
                out += [seg] if len(seg) < n else [seg[i : i + n] for i in range(len(seg) - n + 1)]
        return out

    def t4(s, n=3):
        s = t7(s)
        return {s} - {""} if len(s) < n else {s[i : i + n] for i in range(len(s) - n + 1)}

    assert column(spark, text.token_ngrams) == [t1(s) for s in SAMPLES]
    assert [set(x) for x in column(spark, text.ngram_set)] == [t4(s) for s in SAMPLES]
    assert column(spark, text.hashing_grams) == [[u[i : i + 2] for i in range(len(u) - 1)] for u in (re.sub(r"\s+", "", s) for s in SAMPLES)]


def test_estimates_and_splits(spark):
    assert column(spark, text.token_estimate) == [int(sum(c.isascii() for c in s) * 0.3 + sum(not c.isascii() for c in s) * 1.1) + 1 for s in SAMPLES]
    lists = ["a、b, c", "3.5、x", "3. a", "a.b", "", "・一\n二"]
    assert column(spark, text.split_items, lists) == [[p.strip() for p in re.split(text.LIST_SEPARATORS, s) if p.strip()] for s in lists]
    assert column(spark, text.sentence_units)[4] == ["Straße 3.5 です。", "次の文！", "項目", "two"]
    quotes = ["見出し\n短い。これは十二文字より長い文です。", "abc", "one line that is long enough", "a\n\n"]
    assert column(spark, text.pick_quote, quotes) == ["これは十二文字より長い文です。", None, "one line that is long enough", None]


def test_token_counts_and_tokenizers(spark):
    assert [r["method"] for r in column(spark, lambda t: text.token_count(t, "/nowhere.json"), ["a"])] == ["estimate"]
    with pytest.raises(ImportError):
        text.tokens(F.lit("a"), "sudachi")
    with pytest.raises(ValueError):
        text.tokens(F.lit("a"), "other")


def python_f1(p, r):
    if not p or not r:
        return 1.0 if not p and not r else 0.0
    return 2 * sum((Counter(p) & Counter(r)).values()) / (len(p) + len(r))


def test_scores(spark):
    pairs = [(a, b) for a in ("", "abc", "aabbcc", "5項目", "15", "35") for b in ("", "abc", "cab", "5", "35")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, p string, r string")
    got = rows.select("k", scoring.char_f1(F.col("p"), F.col("r")).alias("f"), scoring.numeric_match(F.col("p"), F.col("r")).alias("n"), scoring.exact_match(F.col("p"), F.array("r")).alias("e"), scoring.contains_answer(F.col("p"), F.array("r")).alias("c")).orderBy("k").collect()
    for (p, r), row in zip(pairs, got, strict=True):
        numbers = lambda s: set(re.findall("[0-9]+", s))
        assert row["f"] == pytest.approx(python_f1(p, r))
        assert row["n"] == (bool(numbers(r)) and numbers(r) <= numbers(p))
        assert row["e"] == (bool(p) and p == r) and row["c"] == (bool(r) and r in p)


def test_windowed_and_set_scores(spark):
    assert scoring.windowed("xxxabcxxx", "abc") == 1.0
    assert scoring.windowed("ab", "abc") == pytest.approx(0.8)
    assert scoring.windowed("", "") == 1.0 and scoring.windowed("a", "") == 0.0
    rows = spark.createDataFrame([(["実施している4点", "x"], ["実施している", "一部"]), ([], []), (["a"], [])], "p array<string>, w array<string>")
    assert [r[0] for r in rows.select(scoring.set_f1(F.col("p"), F.col("w"))).collect()] == [0.5, 1.0, 0.0]


def test_fixed_chunks(spark):
    texts = ["", "a" * 512, "b" * 513, "c" * 961, " " * 600, "d" * 448 + " " * 600]
    docs = spark.createDataFrame([(str(k), t, "m") for k, t in enumerate(texts)], "doc_id string, text string, extra string")
    want = []
    for k, t in enumerate(texts):
        start, number = 0, 0
        while t:
            if t[start : start + 512].strip():
                want.append((f"{k}#c{number:04d}", number, t[start : start + 512], start))
                number += 1
            if start + 512 >= len(t):
                break
            start += 448
    got = chunking.fixed_chunks(docs).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["chunk_ord"], r["text"], r["char_start"]) for r in got] == want
    assert all(r["char_end"] == r["char_start"] + len(r["text"]) and r["extra"] == "m" for r in got)
    with pytest.raises(ValueError):
        chunking.fixed_chunks(docs, 10, 10)


def test_recursive_chunks(spark):
    body = "一つ目の文です。二つ目の文です。\n\n三つ目、四つ目。" * 8
    pieces = chunking.recursive_pieces(body, 40, 8)
    assert all(len(t) <= 48 for t, _ in pieces) and all(body[s : s + len(t)] == t for t, s in pieces)
    assert chunking.recursive_pieces("", 40, 8) == [] and chunking.recursive_pieces("短い", 40, 8) == [("短い", 0)]
    docs = spark.createDataFrame([("d", body)], "doc_id string, text string")
    assert [(r["text"], r["char_start"]) for r in chunking.recursive_chunks(docs, 40, 8).orderBy("chunk_ord").collect()] == pieces


def test_normal_forms_read_each_text_once(spark):
    """All that \\s stands for in Unicode goes, the control characters that only Python counts stay; one Python pass, no
    pattern over whole texts in the JVM."""
    import unicodedata

    odd = [None, "", " \x1cａ ﬁ\x1f b\x85　", "Straße, ΑΣ ſo! （x）", "a​b\x0b\xa0c ", "x\x1d y", "\t(A)_b--c\\d|e'\"`\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    plan = rows.select("k", text.normalize_for_match(F.col("t")).alias("m"), text.normalize_answer(F.col("t")).alias("a"), text.strip(F.col("t")).alias("s"))
    nfkc = rows.select("k", F.regexp_replace(text.nfkc(F.col("t")), r"(?U)\s+", "").alias("m"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s"))
    old = nfkc.withColumn("a", F.replace(F.translate(F.lower(F.regexp_replace("m", text.ANSWER_PUNCTUATION, "")), "ςſ", "σs"), F.lit("ß"), F.lit("ss")))
    got = plan.orderBy("k").collect()
    assert got == [tuple(r) for r in old.select("k", "m", "a", "s").orderBy("k").collect()]
    assert got[2]["m"] == "\x1cafi\x1fb" and unicodedata.normalize("NFKC", "ﬁ") == "fi"
    assert "regexp" not in plan._jdf.queryExecution().executedPlan().toString()


def test_quotes_stop_at_the_first_long_sentence(spark):
    cases = {"Head\n short. \n\n 　A sentence that is long enough to be cut after forty characters。next": "A sentence that is long enough to be cut", "Head\n  \n": None, "only a first line 12": "only a first line 12", "h\nabc！de\n12345678901。": "12345678901。", "h\nab。cd。ef。gh。ij": "ab。cd。ef。gh。ij", "": None}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "k int, t string")
    plan = rows.select("k", text.pick_quote(F.col("t")).alias("q")).orderBy("k")
    assert [r["q"] for r in plan.collect()] == [*cases.values(), None]
    assert "regexp" not in plan._jdf.queryExecution().executedPlan().toString()
