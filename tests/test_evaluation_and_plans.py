"""Evidence, judging, metrics, statistics, layout, sources, configuration and the pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import comparison, evaluation, evidence, layout
from sheaf.plans import config, pipeline, registry
from sheaf.sources import files
from sheaf.streaming import audit

CHUNK = "chunk_id string, doc_id string, chunk_ord int, text string, char_start int, page int, page_start int, page_end int, section_path string"


def test_evidence(spark):
    chunks = spark.createDataFrame([
        ("a0", "a", 0, "最初の文で す。続き", 0, 1, None, None, "章 > 節"), ("a1", "a", 1, "続きの終わり。", 8, None, 8, 10, None), ("b0", "b", 0, "最初の文です。", 0, 5, None, None, None),
    ], CHUNK)
    rows = spark.createDataFrame([
        ("q", 0, "最初の\n文です。", None, None), ("q", 1, "最初の文です。", 5, None), ("q", 2, "す。続きの終", None, None), ("q", 3, "無い", 9, None), ("q", 4, None, 9, None), ("q", 5, None, None, "章>節"), ("q", 6, "無い", None, None),
    ], "qid string, ev_ord int, quote string, page int, section_path string")
    got = {r["ev_ord"]: (r["anchor"], r["quote_status"], list(r["chunk_ids"])) for r in evidence.resolve(rows, chunks).collect()}
    assert got == {
        0: ("quote", "found", ["a0", "b0"]), 1: ("quote", "found", ["b0"]), 2: ("quote", "split_across_chunks", []), 3: ("page", "missing_from_corpus", ["a1"]),
        4: ("page", None, ["a1"]), 5: ("section_path", None, ["a0"]), 6: ("quote", "missing_from_corpus", []),
    }
    report = evidence.resolution_report(evidence.resolve(rows, chunks, page_fallback=False)).first()
    assert (report["found"], report["split_across_chunks"], report["missing_from_corpus"], report["resolvability"]) == (2, 1, 2, 0.4)


def test_substring_pairs_in_blocks(spark):
    texts = spark.createDataFrame([(k, "abcdefgh"[k:] * 2) for k in range(8)], "k int, norm string")
    needles = spark.createDataFrame([("x", n) for n in ("abc", "habc", "zz", "", "h")], "w string, needle string")
    want = {(k, n) for k in range(8) for n in ("abc", "habc", "h") if n in "abcdefgh"[k:] * 2}
    for size in (1 << 20, 4):
        assert {(r["k"], r["needle"]) for r in evidence.substring_pairs(texts, needles, size).collect()} == want


def test_judging(spark):
    gold = [("s", "経営者", [], "short", True), ("n", "5", [], "numeric", True), ("n2", "15", [], "numeric", True), ("l", "A、B", [], "list", True), ("u", None, [], "short", False), ("m", "x", ["  "], "short", True), ("p", "利用者認証を安全に行う技術", [], "short", True)]
    said = [("s", "経営者です。", False), ("n", "15項目", False), ("n2", "15項目", False), ("l", "Aと B", False), ("u", "分かりません", True), ("p", "それは利用者の認証を安全に行う技術のこと", False)]
    rows = evaluation.judge(spark.createDataFrame(gold, "qid string, answer string, answer_aliases array<string>, answer_type string, answerable boolean"), spark.createDataFrame(said, "qid string, text string, abstained boolean"))
    got = {r["qid"]: r["outcome"] for r in rows.collect()}
    assert got == {"s": "correct", "n": "incorrect", "n2": "correct", "l": "correct", "u": "correct_abstention", "m": "incorrect", "p": "correct"}
    rates = evaluation.outcome_rates(rows).first()
    assert rates["n"] == 7 and rates["accuracy"] == round(5 / 7, 4) and rates["abstention_precision"] == 1.0


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("q", k, f"c{k}") for k in range(1, 6)], "qid string, rank int, chunk_id string")
    gold = spark.createDataFrame([("q", 0, ["c1", "c2"]), ("q", 1, ["x"]), ("z", 0, ["y"]), ("w", 0, [])], "qid string, ev_ord int, chunk_ids array<string>")
    got = {r["qid"]: r for r in evaluation.ranking_metrics(hits, gold).collect()}
    assert set(got) == {"q", "z"} and got["q"]["hit_1"] == 1.0 and got["q"]["recall_5"] == 0.5 and got["z"]["reciprocal_rank"] == 0.0
    assert got["q"]["ndcg_5"] == pytest.approx((1 + 0.6309297535714575) / (1 + 0.6309297535714575))
    assert got["q"]["ndcg_1"] == 1.0


def test_statistics(spark):
    values = [0.1, 0.4, 0.35, 0.9]
    draw = random.Random(evaluation.SEED)
    means = sorted(sum(values[draw.randrange(4)] for _ in range(4)) / 4 for _ in range(2000))
    got = evaluation.bootstrap(values)
    assert (got[0], got[1], got[2]) == (pytest.approx(sum(values) / 4), means[50], means[int((1 - (1 - 0.95) / 2) * 2000)])
    w = spark.range(1).select(evaluation.wilson(F.lit(42), F.lit(42)).alias("w"), evaluation.wilson(F.lit(0), F.lit(0)).alias("n")).first()
    assert w["w"]["high"] == 1.0 and 0.9 < w["w"]["low"] < 0.93 and w["n"] is None
    rows = spark.createDataFrame([("a", float(v)) for v in range(10)], "g string, v double")
    assert tuple(evaluation.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first())[1:] == (5.0, 9.0)
    runs = spark.createDataFrame([(r, f"q{k}", "correct", 0.5, 1.0) for r in ("a", "b") for k in range(5)], "run string, qid string, outcome string, char_f1 double, latency_ms double")
    out = comparison.compare(runs, "a").collect()
    assert all(r["diff"] == 0 and not r["significant"] and r["verdict"] == ("基準" if r["run"] == "a" else "有意差なし") for r in out)


def test_sampling(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k < 9 else None) for k in range(12)], "id int, g string")
    got = comparison.stratified_sample(rows, F.col("g"), 6, F.col("id")).collect()
    assert sorted(r["stratum"] for r in got) == ["a", "a", "b", "b", "c", "unknown"]
    assert comparison.stratified_sample(rows, F.col("g"), 0, F.col("id")).count() == 0


def test_layout(spark):
    def fragment(page, text, y0, x0, size=10.0, bold=False):
        return ("d.pdf", page, 1000.0, text, float(y0), float(x0), float(x0 + 9 * len(text)), size, bold)

    pages = [x for p in (1, 2, 3) for x in (fragment(p, "ヘッダー", 20, 100), fragment(p, f"{p}", 980, 300), fragment(p, f"第{p}章", 100, 50, 16.0, True), fragment(p, "本文", 150, 50), fragment(p, "の続き", 153, 90), fragment(p, "重要", 200, 50, 12.0, True), fragment(p, f"中身{p}", 220, 50))]
    rows = layout.rows_of(spark.createDataFrame(pages, "path string, page int, page_height double, text string, y0 double, x0 double, x1 double, size double, bold boolean"))
    kept = layout.without_page_furniture(rows)
    assert {r["text"] for r in kept.collect()} == {"第1章", "第2章", "第3章", "本文 の続き", "重要", "中身1", "中身2", "中身3"}
    parts = layout.sections(layout.headings(kept)).orderBy("doc_id").collect()
    assert [r["section_path"] for r in parts] == ["第1章", "第1章 > 重要", "第2章", "第2章 > 重要", "第3章", "第3章 > 重要"]
    assert parts[0]["text"] == "第1章\n本文 の続き" and parts[0]["doc_id"] == "d#s0000" and {r["heading_level"] for r in parts} == {1, 3}
    run = spark.createDataFrame([("d.pdf", 1, 1000.0, k, f"太字{k}", 100.0 + k, 12.0, True) for k in range(3)], "path string, page int, page_height double, row int, text string, y0 double, size double, bold boolean")
    assert not layout.headings(run).where("heading_level is not null").count()
    assert layout.single(kept).first()["n_pages"] == 3 and layout.pages(kept).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.md").write_text("# A\n本文")
    (tmp_path / "c" / "two.TXT").write_text("x")
    (tmp_path / "c" / "skip.csv").write_text("y")
    assert {(r["doc_id"], r["text"]) for r in files.read_texts(spark, str(tmp_path / "c")).collect()} == {("one", "# A\n本文"), ("two", "x")}
    (tmp_path / "c" / "two.md").write_text("z")
    with pytest.raises(ValueError):
        files.read_texts(spark, str(tmp_path / "c"))
    good = {"qid": "q1", "question": "?", "answer": "a", "answer_type": "short", "evidence": [{"page": 1}], "answerable": True}
    gold = tmp_path / "gold.jsonl"
    gold.write_text("# note\n\n" + json.dumps(good) + "\n")
    assert files.read_gold(spark, str(gold)).first()["qid"] == "q1"
    for bad in (good | {"evidence": [{}]}, good | {"answer": None}, good | {"answer_type": "odd"}):
        gold.write_text(json.dumps(bad) + "\n")
        with pytest.raises(ValueError):
            files.read_gold(spark, str(gold))
    gold.write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    with pytest.raises(ValueError):
        files.read_gold(spark, str(gold))
    lock = {"one.md": "0" * 64, "gone.md": "1" * 64}
    assert {(r["name"], r["fault"]) for r in files.verify_files(spark, str(tmp_path / "c"), lock).collect()} == {("one.md", "differs"), ("gone.md", "missing")}


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\nquery: {generator: {type: extractive, max_sentences: 2}, prompt: {type: template, context_token_budget: 5}}\n")
    (tmp_path / "child.yaml").write_text("extends: base\nname: child\nquery: {generator: {type: openai_compat, base_url: u, model: m}, prompt: {context_token_budget: 7}}\n")
    raw = config.load("child", tmp_path)
    assert raw["query"] == {"generator": {"type": "openai_compat", "base_url": "u", "model": "m"}, "prompt": {"type": "template", "context_token_budget": 7}}
    (tmp_path / "loop.yaml").write_text("extends: loop\n")
    with pytest.raises(config.ConfigError):
        config.load_raw("loop", tmp_path)
    base = config.load("base", tmp_path)
    assert config.config_hash(base) == config.config_hash(base | {"name": "other"})
    variants = config.expand(base, {"query.prompt.context_token_budget": [5, 9], "query.generator.max_sentences": [1]})
    assert [v["name"] for v in variants] == ["base", "base__context_token_budget-9", "base__max_sentences-1"]
    assert len(config.expand(base, {"query.prompt.context_token_budget": [5, 9], "query.generator.max_sentences": [1, 2]}, "grid")) == 4
    with pytest.raises(config.ConfigError):
        config.expand(base, {"query.nothing": [1]})
    with pytest.raises(registry.RegistryError, match="did you mean 'extractive'"):
        registry.build("generator", {"type": "extractiv"})
    with pytest.raises(registry.RegistryError, match="no option 'max_sentence'"):
        config.plan(base, {"query.generator": [{"type": "extractive", "max_sentence": 1}]})
    assert [r[2] for r in config.run_all([{"name": "a"}, {"name": "b"}], lambda v: 1 / (v["name"] == "a"))] == [None, "ZeroDivisionError: division by zero"]


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "多要素認証は二つ以上の要素で本人を確かめます。\n\nパスワードは十文字以上にします。"), ("d2", "休暇は年に二十日です。")], "doc_id string, text string")
    index = pipeline.build_index(spark, pipeline.SMOKE, docs, str(tmp_path))
    again = pipeline.build_index(spark, pipeline.SMOKE, None, str(tmp_path))
    assert again["chunks"].count() == index["chunks"].count() > 0
    out = pipeline.ask(again, "休暇は年に何日ですか", pipeline.SMOKE)
    assert "二十日" in out["answer"] and out["citations"] and not out["abstained"]
    hybrid = config.merge(pipeline.SMOKE, {"query": {"retriever": {"type": "hybrid", "top_k": 2}}})
    trace = pipeline.Trace()
    questions = spark.createDataFrame([("q1", "パスワードは何文字ですか"), ("q2", "xyzzy plugh")], "qid string, question string")
    said = {r["qid"]: r for r in pipeline.answer(again, questions, hybrid, trace)["answers"].collect()}
    assert "十文字" in said["q1"]["text"] and said["q2"]["abstained"] and len(trace.rows) >= 8


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2026-01-01", "c", "smoke", "q", "secret")], "at string, client string, config string, question string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("at string, client string, config string, question string, text string").json(str(tmp_path / "in"))
    audit.audit_log(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).columns == ["at", "client", "config", "question"]


def test_bootstrap_holds_a_few_series():
    """2000 draws of 5000 numbers would be 80 MB of places alone; the means are those of the standard library's draws."""
    import tracemalloc

    values = [k % 100 / 100 for k in range(5000)]
    tracemalloc.start()
    got = evaluation.bootstrap(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    draw = random.Random(evaluation.SEED)
    means = sorted(sum(values[draw.randrange(5000)] for _ in range(5000)) / 5000 for _ in range(2000))
    assert got == (sum(values) / 5000, means[50], means[1950])


def test_intervals_of_groups_over_several_batches(spark):
    table = [("a" if k % 3 else None, k % 2, f"q{k:04d}", None if k % 7 == 0 else k / 90) for k in range(90)] + [("z", 0, "q", None), ("y", 1, "q", 2.5)]
    rows = spark.createDataFrame(table, "g string, h int, qid string, value double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        plan = evaluation.intervals(rows, ["g", "h"])
        got = {(r["g"], r["h"]): (r["n"], r["point"], r["low"], r["high"]) for r in plan.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsIn" not in plan._jdf.queryExecution().toString()
    for key in {t[:2] for t in table}:
        own = [v for *k, _, v in table if tuple(k) == key and v is not None]
        assert got.pop(key) == (len(own), *(evaluation.bootstrap(own) or (None, None, None)))
    assert not got


def test_rows_of_many_pages_at_once(spark):
    """Rows of pages that come in one batch are those of each page alone; no page becomes a frame of its own."""
    draw = random.Random(5)
    table = []
    for page in range(30):
        for _ in range(draw.randrange(1, 40)):
            x = draw.randrange(40) * 2.0
            table.append((f"d{page % 3}.pdf", page // 3, 800.0, draw.choice(["a", "bb", "cc", "ß語"]), draw.randrange(60) * draw.choice([0.5, 1.0]), x + draw.random() / 8, x + draw.choice([1.0, 7.0, 30.0]), draw.choice([9.0, 12.0]), draw.random() < 0.5))
    names = ["path", "page", "page_height", "text", "y0", "x0", "x1", "size", "bold"]
    want = []
    for key in sorted({t[:2] for t in table}):
        groups = []
        for f in sorted((dict(zip(names, t, strict=True)) for t in table if t[:2] == key), key=lambda f: (f["y0"], f["x0"])):
            if groups and f["y0"] - groups[-1][0]["y0"] <= 4.0:
                groups[-1].append(f)
            else:
                groups.append([f])
        want += [(*key, 800.0, k, *layout.assembled(g, 2.0).values()) for k, g in enumerate(groups)]
    plan = layout.rows_of(spark.createDataFrame(table, "path string, page int, page_height double, text string, y0 double, x0 double, x1 double, size double, bold boolean").repartition(3))
    assert sorted(tuple(r) for r in plan.collect()) == want
    assert "FlatMapGroupsIn" not in plan._jdf.queryExecution().toString()
    fragments = spark.createDataFrame(table, "path string, page int, page_height double, text string, y0 double, x0 double, x1 double, size double, bold boolean")
    pages = fragments.groupBy("path", "page", "page_height").agg(F.collect_list(F.struct("text", "y0", "x0", "x1", "size", "bold")).alias("fragments"))
    nested = layout.rows_of_pages(pages.unionByName(pages.limit(1).withColumns({"page": F.lit(99), "fragments": F.array().cast(pages.schema["fragments"].dataType)})))
    assert sorted(tuple(r) for r in nested.collect()) == want


def test_sections_of_many_documents_at_once(spark):
    table = [(f"x/d{d}.pdf", p, 800.0, r, f"Title {d}" if r == 0 else "Label" if r == 2 and d else f"body {d} {p} {r}.", 100.0 + r, 16.0 if r == 0 else 12.0, r in (0, 2)) for d in range(4) for p in (1, 2, 3) for r in range(4)]
    rows = spark.createDataFrame(table, "path string, page int, page_height double, row int, text string, y0 double, size double, bold boolean")
    plan = layout.sections(layout.headings(rows.repartition(3)))
    got = {}
    for r in plan.collect():
        got.setdefault(r["path"], []).append((r["doc_id"], r["section_path"], r["heading_level"], r["text"]))
    assert sorted(got) == [f"x/d{d}.pdf" for d in range(4)] and [len(got[p]) for p in sorted(got)] == [3, 6, 6, 6]
    # labels of three pages go one level below the deepest
    assert sorted(got["x/d1.pdf"])[:2] == [("d1#s0000", "Title 1", 3, "Title 1\nbody 1 1 1."), ("d1#s0001", "Label", 3, "Label\nbody 1 1 3.")]
    assert sorted(got["x/d0.pdf"])[0][::3] == ("d0#s0000", "Title 0\nbody 0 1 1.\nbody 0 1 2.\nbody 0 1 3.")
    text = plan._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in text and "Join" not in text


def test_whole_groups():
    import pyarrow as pa

    from sheaf.sources.grouped import whole_groups

    keys = [None, None, 1, 2, 2, 2, 2, 2, 2, 2, 3]
    for size in (1, 2, 5, 11):
        batches = pa.table({"k": pa.array(keys)}).to_batches(size)
        parts = [(b.column("k").to_pylist(), s.tolist()) for b, s in whole_groups(iter(batches), ["k"], 3)]
        assert sum((k for k, _ in parts), []) == keys
        assert [k[i] for k, s in parts for i in s] == [None, 1, 2, 3]
