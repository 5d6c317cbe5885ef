"""Retrieval, fusion, contexts, prompts and answers on small tables."""

import json
import math
import random
import re
import threading
import unicodedata
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import answers, contexts, retrieval, vectors

TEXTS = ["the cat sat", "the dog sat on the mat", "", "a bird", "the the the cat", "zzz"]


def chunks(spark):
    return spark.createDataFrame([(f"c{k}", k, t) for k, t in enumerate(TEXTS)], "chunk_id string, corpus_ord int, text string")


def grams(t):
    return [g for s in t.lower().split() for g in ([s] if len(s) < 2 else [s[i : i + 2] for i in range(len(s) - 1)])]


def bm25(query):
    docs = [grams(t) or ["__empty__"] for t in TEXTS]
    df = Counter(g for d in docs for g in set(d))
    raw = {g: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for g, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {g: 0.25 * mean if v < 0 else v for g, v in raw.items()}
    length = sum(map(len, docs)) / len(docs)
    return [sum(idf.get(g, 0) * Counter(d)[g] * 2.5 / (Counter(d)[g] + 1.5 * (0.25 + 0.75 * len(d) / length)) for g in grams(query)) for d in docs]


def test_bm25_with_zero_fill(spark):
    asked = [("q1", 0, "the cat cat"), ("q2", 0, "qqq"), ("q3", 0, " 。 "), ("q4", 0, "bird"), ("q4", 1, "mat dog")]
    hits = retrieval.bm25(spark.createDataFrame(asked, "qid string, q_ord int, text string"), chunks(spark), 4).collect()
    for qid, queries in (("q1", ["the cat cat"]), ("q2", ["qqq"]), ("q4", ["bird", "mat dog"])):
        scores = np.max([bm25(q) for q in queries], axis=0)
        want = sorted(range(len(TEXTS)), key=lambda k: (-round(scores[k], 9), k))[:4]
        own = sorted((r for r in hits if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in own] == [f"c{k}" for k in want]
        assert [r["score"] for r in own] == pytest.approx([scores[k] for k in want])
    assert not [r for r in hits if r["qid"] == "q3"]


def test_dense_and_vectors(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(40, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[7] = m[3]
    table = spark.createDataFrame([(f"c{k}", k, v.tolist()) for k, v in enumerate(m)], "chunk_id string, corpus_ord int, vec array<double>").repartition(3)
    hits = vectors.vector_topk(spark.createDataFrame([("q", m[3].tolist())], "qid string, vec array<double>"), table, 3).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits][:2] == ["c3", "c7"]
    two = spark.createDataFrame([("q", 0, m[3].tolist()), ("q", 1, m[5].tolist())], "qid string, q_ord int, vec array<double>")
    best = np.maximum(m @ m[3], m @ m[5])
    assert [h["chunk_id"] for h in retrieval.dense(two, table, 4).orderBy("rank").collect()] == [f"c{k}" for k in sorted(range(40), key=lambda k: (-round(best[k], 12), k))[:4]]
    assert vectors.vector_topk(spark.createDataFrame([], "qid string, vec array<double>"), table).count() == 0
    assert vectors.prefix_style("intfloat/multilingual-e5-base") == "e5" and vectors.prefix_style("BAAI/bge-m3") == "bge" and vectors.prefix_style("other") == "none"


def test_hashing_embedding(spark):
    rows = spark.createDataFrame([("a", "abcab"), ("b", "x"), ("c", "ABC")], "id string, text string")
    got = {r["id"]: np.array(r["vec"]) for r in vectors.hashing_embedding(rows, "id", 16).collect()}
    want = np.zeros(16)
    for g in ("ab", "bc", "ca", "ab"):
        slot, sign = vectors._slot(g, 16)
        want[slot] += sign
    assert got["a"] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert not got["b"].any() and not np.allclose(got["c"], got["a"])


def test_fusion_is_stable(spark):
    lists = [[("a", 3.0), ("b", 2.0), ("c", 1.0)], [("c", 9.0), ("d", 8.0), ("a", 7.0)]]
    frames = []
    for hits in lists:
        rows = [("q", k + 1, c, ord(c), s) for k, (c, s) in enumerate(hits)]
        random.Random(1).shuffle(rows)
        frames.append(spark.createDataFrame(rows, "qid string, rank int, chunk_id string, corpus_ord int, score double"))
    out = retrieval.fuse([("dense", frames[0]), ("bm25", frames[1])], 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["a", "c", "b", "d"]  # a and c tie: the earlier list decides
    assert out[0]["provenance"] == {"dense": 3.0, "dense_rank": 1.0, "bm25": 7.0, "bm25_rank": 3.0, "rrf": pytest.approx(1 / 61 + 1 / 63)}
    assert set(retrieval.fuse([("x", frames[0]), ("x", frames[1])]).first()["provenance"]) >= {"x_0", "x_1"}
    with pytest.raises(ValueError):
        retrieval.fuse([("a", frames[0])], weights=[1, 2])


def test_queries(spark):
    one = spark.createDataFrame([("ＭＦＡ  とは 認証",)], "t string")
    got = one.select(retrieval.normalized_query(F.col("t")).alias("n"), retrieval.synonym_queries(F.col("t"), {"MFA": ["多要素認証", "2FA"], "無い": ["x"]}).alias("s"), retrieval.synonym_queries(F.col("t"), {"MFA": ["a", "b", "c"]}, max_queries=1).alias("m")).first()
    assert got["n"] == ["MFA とは 認証"] and got["s"] == ["MFA  とは 認証", "多要素認証  とは 認証", "2FA  とは 認証"] and len(got["m"]) == 2


def context_rows(spark, rows):
    return spark.createDataFrame([("q", p, f"c{p}", s, t, sec, None) for p, s, t, sec in rows], "qid string, pos int, chunk_id string, score double, text string, section_path string, page int")


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("pos").collect()]


def test_context_operators(spark):
    rows = context_rows(spark, [(k, s, f"text {k}", None) for k, s in enumerate([0.5, 0.9, 0.5, 0.1, 0.7], 1)])
    assert ids(contexts.reorder_lost_in_middle(rows)) == ["c2", "c1", "c4", "c3", "c5"]
    assert ids(contexts.top_k(rows, 2)) == ["c1", "c2"]
    near = context_rows(spark, [(1, 0.2, "abcdefghij", None), (2, 0.9, "abcdefghij", None), (3, 0.5, "zzzzzz", None), (4, 0.4, "", None), (5, 0.4, "", None)])
    assert ids(contexts.dedupe(near, 0.9)) == ["c2", "c3", "c4", "c5"]
    named = contexts.add_section_path(context_rows(spark, [(1, 1.0, "t", "A > B"), (2, 1.0, "u", None), (3, 1.0, "v", "")]))
    assert [r["text"] for r in named.orderBy("pos").collect()] == ["【A > B】\nt", "u", "v"]


def test_budget(spark):
    sizes = [500, 600, 700, 200]
    rows = context_rows(spark, [(k, 1.0, "あ" * int((n - 1) / 1.1 + 0.99), None) for k, n in enumerate(sizes, 1)])
    skip = contexts.within_budget(rows, 1305).first()
    assert [c["chunk_id"] for c in skip["contexts"]] == ["c1", "c2", "c4"] and skip["n_dropped"] == 1
    cut = contexts.within_budget(rows, 1305, "truncate_each").first()
    assert [c["chunk_id"] for c in cut["contexts"]] == ["c1", "c2", "c3"] and (cut["n_dropped"], cut["n_truncated"]) == (1, 1)
    assert len(contexts.within_budget(rows, None).first()["contexts"]) == 4


def test_prompt_and_answers(spark):
    questions = spark.createDataFrame([("q", "認証の方法は何ですか"), ("r", "xyz")], "qid string, question string")
    rows = context_rows(spark, [(1, 1.0, "# 認証\n認証の方法はパスワードです。天気は晴れ。", "認証"), (2, 0.5, "- 認証の方法は何か。", None)])
    made = contexts.prompts(questions, rows, budget=1000)
    user = {r["qid"]: r["messages"][-1]["content"] for r in made.collect()}
    assert user["q"] == "# 参考文書\n\n[1] （認証）\n# 認証\n認証の方法はパスワードです。天気は晴れ。\n\n[2]\n- 認証の方法は何か。\n\n# 質問\n\n認証の方法は何ですか"
    said = answers.extractive(made)
    out = {r["qid"]: r for r in answers.abstain_on_phrase(answers.parse_citations(said, made)).collect()}
    assert out["q"]["text"] == "認証の方法は何か。 認証の方法はパスワードです。 [1] [2]" and list(out["q"]["citations"]) == ["c1", "c2"] and not out["q"]["abstained"]
    assert out["r"]["text"] == "分かりません" and out["r"]["abstained"] and out["r"]["raw_text"] == ""
    free = spark.createDataFrame([("q", "答え [1] [1] [9]", "", False), ("r", "何も無い", "", False)], "qid string, text string, raw_text string, abstained boolean")
    cited = {r["qid"]: r for r in answers.abstain_without_citation(answers.parse_citations(free, made, remove=True)).collect()}
    assert cited["q"]["text"] == "答え" and list(cited["q"]["citations"]) == ["c1"] and list(cited["q"]["invalid_citations"]) == [9]
    assert cited["r"]["text"] == "分かりません" and cited["r"]["raw_text"] == "何も無い" and cited["r"]["abstained"]
    both = made.select(contexts.split_prompt(F.lit("x<<<SYSTEM>>>\ns\n<<<USER>>>\nu\n")).alias("p")).first()["p"]
    assert (both["system"], both["user"]) == ("s", "u")


def test_service(spark):
    class Handler(BaseHTTPRequestHandler):
        def reply(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self.reply({"data": [{"id": "m"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply({"choices": [{"message": {"content": f" {asked['messages'][-1]['content'][-3:]} [1] "}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = answers.ChatClient(f"http://127.0.0.1:{server.server_port}", "m")
    assert client.health_check() and client.list_models() == ["m"]
    questions = spark.createDataFrame([("q", "abc")], "qid string, question string")
    made = contexts.prompts(questions, context_rows(spark, [(1, 1.0, "t", None)]))
    row = answers.parse_citations(answers.generated(made, client, 1), made).first()
    assert row["text"] == "abc [1]" and list(row["citations"]) == ["c1"] and row["prompt_tokens"] == 3
    server.shutdown()
    with pytest.raises(RuntimeError):
        answers.ChatClient("http://127.0.0.1:9", "m", timeout=1).complete([])


def test_vector_search_holds_a_tile_of_scores():
    """Three batches of vectors with many copies against 4000 queries: all scores at once would be 128 MB."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    m = r.normal(size=(4000, 16))
    m[1000:3000] = m[999]
    m[3500:] = m[:500]
    batches = [pa.record_batch([pa.array([f"c{i}" for i in part]), pa.array(part), pa.array(m[part].tolist())], names=["chunk_id", "corpus_ord", "vec"]) for part in np.array_split(r.permutation(4000), 3)]
    tracemalloc.start()
    got = pa.Table.from_batches(vectors._searched(m, np.arange(4000), pa.int64(), 5)(iter(batches))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    exact = (m[::97][:, None].astype(np.longdouble) * m[None]).sum(axis=2).astype(float)
    for q, own in zip(range(0, 4000, 97), exact, strict=True):
        best = sorted(range(4000), key=lambda k: (-own[k], k))[:5]
        assert sorted(got[got["qid"] == q].sort_values(["score", "corpus_ord"], ascending=[False, True])["corpus_ord"]) == sorted(best)


def test_lsh_pairs_are_not_joined(spark):
    """The join of the library gives the same neighbours; here no row leaves a task but the k best of each query."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    m = r.normal(size=(60, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[9], m[20] = m[4], -m[4]
    table = spark.createDataFrame([(f"c{k}", k, v.tolist()) for k, v in enumerate([*m, m[4]])] + [("c4", 4, m[4].tolist())], "chunk_id string, corpus_ord int, vec array<double>")
    asked = table.where("corpus_ord % 4 = 0").selectExpr("chunk_id as qid", "vec")
    for bucket, tables in ((1.0, 12), (0.2, 2)):
        lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=42)
        left, right = asked.withColumn("v", array_to_vector("vec")), table.withColumn("v", array_to_vector("vec"))
        near = lsh.fit(right).approxSimilarityJoin(left, right, 2.0, "distance")
        want = vectors.ranked(near.select("datasetA.qid", "datasetB.chunk_id", "datasetB.corpus_ord", (1 - F.col("distance") ** 2 / 2).alias("score")), 5)
        out = vectors.vector_lsh(asked, table, 5, bucket, tables)
        rows = lambda df: sorted((x["qid"], x["rank"], x["chunk_id"], round(x["score"], 9)) for x in df.collect())
        assert rows(out) == rows(want)
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString() and "Generate" not in out._jdf.queryExecution().toString()


def test_dedupe_counts_shared_grams_at_once(spark):
    """The fold over 700 contexts of two questions, against sets; no array of grams leaves the texts."""
    import random

    draw = random.Random(3)
    base = ["".join(draw.choice("abcde 日本ß") for _ in range(60)) for _ in range(12)]
    texts = [(lambda t, k: t[:k] + draw.choice("xyz") + t[k + 1 :])(draw.choice(base), draw.randrange(60)) if k % 9 else draw.choice(["", " ", "ab", "a b", "ｂ", None]) for k in range(700)]
    rows = spark.createDataFrame([(f"q{k % 2}", k, f"c{k}", (k * 37 % 50) / 50, t, None, None) for k, t in enumerate(texts)], "qid string, pos int, chunk_id string, score double, text string, section_path string, page int")
    for n, threshold in ((3, 0.8), (2, 0.9), (5, 0.6)):
        want = []
        for q in (0, 1):
            kept = []
            for k in sorted(range(q, 700, 2), key=lambda k: (-(k * 37 % 50), k)):
                t = "".join(unicodedata.normalize("NFKC", texts[k] or "").split())
                g = {t[i : i + n] for i in range(max(len(t) - n, 0) + 1)} if t else set()
                if not any(g and o and len(g & o) >= len(g | o) * threshold for _, o in kept):
                    kept.append((k, g))
            want += [(f"q{q}", i, f"c{k}") for i, (k, _) in enumerate(kept, 1)]
        plan = contexts.dedupe(rows.repartition(3), threshold, n)
        assert sorted((r["qid"], r["pos"], r["chunk_id"]) for r in plan.collect()) == sorted(want)
        assert "array_intersect" not in plan._jdf.queryExecution().toString()


def test_bigrams_are_counted_where_they_are_cut(spark):
    texts = [(1, "The the cat… -- a　x"), (1, "THE end"), (2, "ＡＢＣ 日本語 😀 😀😀 ，。 b"), (3, None), (4, ""), (5, "--- ．\n"), (6, "a,b " * 300), (None, "the")]
    rows = spark.createDataFrame(texts * 2, "doc_id long, text string").repartition(3)
    n, df = Counter(), {}
    for k, t in texts * 2:
        for s in unicodedata.normalize("NFKC", t or "").lower().split():
            if not re.match(text.TOKEN_NOISE, s):
                for g in [s] if len(s) < 2 else [s[i : i + 2] for i in range(len(s) - 1)]:
                    n[g] += 1
                    df.setdefault(g, set()).add(k)
    plan = retrieval.bigram_counts(rows, "doc_id")
    assert sorted(tuple(r) for r in plan.collect()) == sorted((g, n[g], len(df[g])) for g in n)
    assert "explode" not in plan._jdf.queryExecution().toString()


def test_scoring_holds_few_rows_of_a_batch():
    """A batch of 6000 chunks against 300 terms: rows go through in parts, also where the batch is a slice itself."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(4)
    hashed = [r.integers(0, 300, 40).tolist() for _ in range(6000)]
    batch = pa.record_batch([pa.array([f"c{k}" for k in range(6000)]), pa.array(range(6000)), pa.array(hashed)], names=["chunk_id", "corpus_ord", "terms"]).slice(3)
    counted = pa.Table.from_batches(retrieval._counted(iter([batch]))).combine_chunks().to_batches()[0]
    assert dict(zip(counted.column("terms")[7].as_py(), counted.column("tfs")[7].as_py(), strict=True)) == Counter(hashed[10])
    matrix = np.vstack([r.random((300, 4)), np.zeros(4)])
    tracemalloc.start()
    got = pa.Table.from_batches(retrieval._scored(np.arange(300), matrix, np.array([0, 1, 3]), np.array(["a", "b", "c"]), pa.string(), 40.0, 5, 1.5, 0.75)(iter([counted]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # a weight for each chunk and term would be 14 MB
    weights = np.zeros((5997, 301))
    for k, own in enumerate(hashed[3:]):
        for t, c in Counter(own).items():
            weights[k, t] = c / (c + 1.5)
    best = (weights @ matrix)[:, 1:3].max(axis=1)
    own = got[got["qid"] == "b"].sort_values(["score", "corpus_ord"], ascending=[False, True])[:5]
    assert own["corpus_ord"].tolist() == (np.lexsort((np.arange(5997), -best))[:5] + 3).tolist()
