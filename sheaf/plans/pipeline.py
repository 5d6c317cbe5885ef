"""Questions to answers over tables: the index side once, the query side for all questions at once."""

from __future__ import annotations

import platform
import time
from collections.abc import Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import tokens
from sheaf.operators import answers, chunking, contexts, retrieval, vectors
from sheaf.sources import files, scratch

from . import config, registry

register = registry.register


class Trace:
    """what each stage took, kept also when it fails."""

    def __init__(self):
        self.rows: list[dict[str, Any]] = []

    @contextmanager
    def stage(self, stage: str, impl: str, **info: Any):
        entry = {"seq": len(self.rows), "stage": stage, "impl": impl, "info": info}
        self.rows.append(entry)
        began = time.perf_counter()
        try:
            yield entry
        except Exception as error:
            entry["info"] = info | {"error": str(error)}
            raise
        finally:
            entry["duration_ms"], entry["rss_mb"] = (time.perf_counter() - began) * 1000, rss_mb()


def rss_mb() -> float:
    """Resident memory of this process."""
    status = Path("/proc/self/status")
    line = next((x for x in status.read_text().splitlines() if x.startswith("VmRSS")), "0 0") if status.exists() else "0 0"
    return int(line.split()[1]) / 1024


def environment(spark: SparkSession, label: str = "") -> dict[str, Any]:
    """F5."""
    return {"label": label, "platform": platform.platform(), "python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism}


@register("loader", "text")
def _text(recursive: bool = True, encoding: str = "utf-8"):
    return lambda spark, path: files.read_texts(spark, path, recursive, encoding)


@register("chunker", "fixed")
def _fixed(chunk_size: int = 512, overlap: int = 64):
    return lambda docs: chunking.fixed_chunks(docs, chunk_size, overlap)


@register("chunker", "recursive_ja")
def _recursive(chunk_size: int = 512, overlap: int = 64, separators: list[str] | None = None):
    return lambda docs: chunking.recursive_chunks(docs, chunk_size, overlap, tuple(separators) if separators else chunking.SEPARATORS)


@register("embedder", "hashing")
def _hashing(dim: int = 256, ngram: int = 2, normalize: bool = True):
    return lambda rows, key, query=False: vectors.hashing_embedding(rows, key, dim, ngram, normalize)


@register("embedder", "sentence_transformers")
def _model(model: str = "intfloat/multilingual-e5-base"):
    return lambda rows, key, query=False: vectors.model_embedding(rows, key, model, query=query)


@register("indexer", "numpy_flat")
@register("indexer", "faiss")
def _flat(metric: str = "cosine", factory: str = "flat"):
    if metric != "cosine":
        raise ValueError("vectors are compared by cosine")
    return vectors.vector_lsh if factory == "hnsw" else vectors.vector_topk


@register("query_transform", "identity")
def _identity():
    return lambda c: retrieval.identity(c)


@register("query_transform", "normalize")
def _normalize(nfkc: bool = True):
    return lambda c: retrieval.normalized_query(c, nfkc)


@register("query_transform", "synonym_expand")
def _synonyms(synonyms: Mapping[str, list[str]], max_queries: int = 4):
    return lambda c: retrieval.synonym_queries(c, synonyms, max_queries)


@register("retriever", "dense")
def _dense(index: Mapping[str, DataFrame], embed, search=vectors.vector_topk, top_k: int = 5):
    def run(queries: DataFrame) -> DataFrame:
        keyed = queries.withColumn("key", F.to_json(F.struct("qid", "q_ord")))
        embedded = embed(keyed.select("key", "text"), "key", query=True)
        return retrieval.dense(keyed.select("qid", "q_ord", "key").join(embedded, "key").drop("key"), index["vectors"], top_k, search)

    return run


@register("retriever", "sparse")
def _sparse(index: Mapping[str, DataFrame], top_k: int = 5, tokenizer: str = "char_ngram", tokenizer_options: Mapping[str, Any] | None = None, k1: float = retrieval.K1, b: float = retrieval.B):
    tokens(F.lit(""), tokenizer)
    return lambda queries: retrieval.bm25(queries, index["chunks"], top_k, (tokenizer_options or {}).get("n", 2), k1, b)


@register("retriever", "hybrid")
def _hybrid(index: Mapping[str, DataFrame], embed, search=vectors.vector_topk, top_k: int = 5, retrievers: list | None = None, weights: list[float] | None = None, rrf_k: float = retrieval.RRF_K):
    specs = retrievers or [{"type": "dense", "top_k": retrieval.CHILD_K}, {"type": "sparse", "top_k": retrieval.CHILD_K}]
    children = [(s["type"], registry.build("retriever", {"top_k": top_k} | dict(s), index=index, embed=embed, search=search)) for s in specs]
    return lambda queries: retrieval.fuse([(name, child(queries)) for name, child in children], top_k, weights, rrf_k)


@register("post_retrieval", "top_k")
def _top_k(k: int):
    return lambda rows: contexts.top_k(rows, k)


@register("post_retrieval", "reorder_lost_in_middle")
def _reorder():
    return contexts.reorder_lost_in_middle


@register("post_retrieval", "dedupe")
def _dedupe(threshold: float = 0.9, ngram: int = 3):
    return lambda rows: contexts.dedupe(rows, threshold, ngram)


@register("post_retrieval", "add_section_path")
def _section():
    return contexts.add_section_path


@register("prompt", "template")
def _template(path: str = "", context_token_budget: int | None = None, overflow_policy: str = "drop_lowest", instruction_role: str = "system"):
    own = {"instructions": Path(path).read_text(encoding="utf-8")} if path else {}
    return lambda questions, rows: contexts.prompts(questions, rows, context_token_budget, overflow_policy, instruction_role, **own)


@register("generator", "extractive")
def _extractive(max_sentences: int = 2, min_score: float = 0.15, skip_headings: bool = True):
    return lambda prompts: answers.extractive(prompts, max_sentences, min_score, skip_headings)


@register("generator", "openai_compat")
def _service(base_url: str, model: str, temperature: float = 0.0, max_tokens: int = 512, seed: int | None = 42, top_p: float | None = None, timeout: float = 120.0, extra_body: Mapping | None = None, concurrency: int = 4):
    client = answers.ChatClient(base_url, model, temperature, max_tokens, seed, top_p, timeout, extra_body=dict(extra_body or {}))
    return lambda prompts: answers.generated(prompts, client, concurrency)


@register("post_generation", "parse_citations")
def _citations(remove: bool = False):
    return lambda rows, prompts: answers.parse_citations(rows, prompts, remove)


@register("post_generation", "abstain_on_phrase")
def _phrase(phrases: list[str] | None = None):
    return lambda rows, prompts: answers.abstain_on_phrase(rows, tuple(phrases or answers.ABSTAIN_PHRASES))


@register("post_generation", "abstain_without_citation")
def _uncited(message: str = answers.ABSTAIN_TEXT):
    return lambda rows, prompts: answers.abstain_without_citation(rows, message)


def build_index(spark: SparkSession, raw: Mapping[str, Any], docs: DataFrame | None = None, folder: str | None = None, corpus: str = "") -> dict[str, DataFrame]:
    """Chunks and vectors; with a folder they are kept under the index signature and reused when complete."""
    own = raw["index"]
    signature = config.index_signature(raw, corpus or raw.get("corpus", ""))
    place = f"{folder}/{signature}" if folder else None
    if place and (found := files.load_artifact(spark, place, signature)) is not None:
        return found
    docs = registry.build("loader", own["loader"])(spark, raw["corpus"]) if docs is None else docs
    chunks = registry.build("chunker", own["chunker"])(docs)
    chunks = chunks.withColumn("corpus_ord", F.col("chunk_id"))  # files are read in the order of their names
    chunks = scratch.stored(chunks, "chunks") if place is None else chunks
    embedded = registry.build("embedder", own["embedder"])(chunks.select("chunk_id", "text"), "chunk_id")
    # the order in the corpus is the chunk's name: no join
    tables = {"chunks": chunks, "vectors": embedded.withColumn("corpus_ord", F.col("chunk_id"))}
    if place:
        files.save_artifact(place, tables, signature)
        return files.load_artifact(spark, place, signature)
    return tables | {"vectors": scratch.stored(tables["vectors"], "vectors")}


def answer(index: Mapping[str, DataFrame], questions: DataFrame, raw: Mapping[str, Any], trace: Trace | None = None) -> dict[str, DataFrame]:
    """queries, hits, contexts, prompts and answers of a table of questions (qid, question). Hits, prompts and answers
    are written as they are made, so each is computed once and the trace times the work itself."""
    own, trace = raw["query"], trace or Trace()
    embed = registry.build("embedder", raw["index"]["embedder"])
    search = registry.build("indexer", raw["index"].get("indexer", {"type": "numpy_flat"}))
    with trace.stage("query_transform", own["query_transform"]["type"]):
        queries = retrieval.queries_of(questions, registry.build("query_transform", own["query_transform"])(F.col("question")))
    with trace.stage("retriever", own["retriever"]["type"]):
        hits = scratch.stored(registry.build("retriever", own["retriever"], index=index, embed=embed, search=search)(queries), "hits")
    rows = contexts.from_hits(hits, index["chunks"])
    for spec in own.get("post_retrieval", []):
        with trace.stage("post_retrieval", spec["type"]):
            rows = registry.build("post_retrieval", spec)(rows)
    with trace.stage("prompt", own["prompt"]["type"]):
        prompts = scratch.stored(registry.build("prompt", own["prompt"])(questions, rows), "prompts")
    with trace.stage("generator", own["generator"]["type"]):
        said = scratch.stored(registry.build("generator", own["generator"])(prompts), "answers")
    for spec in own.get("post_generation", []):
        with trace.stage("post_generation", spec["type"]):
            said = registry.build("post_generation", spec)(said, prompts)
    return {"queries": queries, "hits": hits, "contexts": rows, "prompts": prompts, "answers": said}


def ask(index: Mapping[str, DataFrame], question: str, raw: Mapping[str, Any]) -> dict[str, Any]:
    """one question's answer as a dictionary."""
    if not 1 <= len(question) <= 2000:
        raise ValueError("a question has 1 to 2000 characters")
    spark = index["chunks"].sparkSession
    tables = answer(index, spark.createDataFrame([("q", question)], "qid string, question string"), raw)
    row = tables["answers"].first()
    return {"question": question, "answer": row["text"], "citations": list(row["citations"]), "abstained": row["abstained"], "contexts": [r.asDict() for r in contexts.context_views(tables["prompts"]).orderBy("number").collect()]}


#: A configuration without optional libraries.
SMOKE = {
    "name": "smoke",
    "index": {"loader": {"type": "text"}, "chunker": {"type": "recursive_ja", "chunk_size": 300, "overlap": 40}, "embedder": {"type": "hashing", "dim": 512, "ngram": 2}, "indexer": {"type": "numpy_flat", "metric": "cosine"}},
    "query": {
        "query_transform": {"type": "normalize"}, "retriever": {"type": "dense", "top_k": 5},
        "post_retrieval": [{"type": "dedupe", "threshold": 0.9}, {"type": "top_k", "k": 3}, {"type": "reorder_lost_in_middle"}],
        "prompt": {"type": "template", "context_token_budget": 1200, "overflow_policy": "drop_lowest"}, "generator": {"type": "extractive", "max_sentences": 2},
        "post_generation": [{"type": "parse_citations"}, {"type": "abstain_on_phrase"}],
    },
}
