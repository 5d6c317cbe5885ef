"""Answers: extractive (G1), by an OpenAI-compatible service (G2), and the checks after generation (K1 to K3)."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import ngram_set, sentence_units, strip

#: Fixed values.
CITATION = r"\[(\d+)\]"
ABSTAIN_PHRASES = ("分かりません", "わかりません", "不明です", "記載がありません")
ABSTAIN_TEXT = "分かりません"


def extractive(prompts: DataFrame, max_sentences: int = 2, min_score: float = 0.15, skip_headings: bool = True, unicode: bool = True) -> DataFrame:
    """G1: (qid, text, raw_text, citations, abstained). Units of the contexts by Dice overlap of their bigrams with the
    question's; contexts stay structured, so neither a header line nor a bracketed number in a text makes a unit."""
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must lie between 0 and 1")
    asked = prompts.select("qid", ngram_set(F.col("question"), 2, unicode).alias("q"), F.posexplode("contexts").alias("i", "c"))
    units = asked.select("qid", "q", (F.col("i") + 1).alias("marker"), F.posexplode(sentence_units(F.col("c.text"), skip_headings)).alias("u", "unit"))
    grams = units.withColumn("g", ngram_set(F.col("unit"), 2, unicode))
    score = F.coalesce(F.try_divide(2 * F.size(F.array_intersect("q", "g")), F.size("q") + F.size("g")), F.lit(0.0))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "marker", "u")
    kept = grams.withColumn("score", score).where(F.col("score") >= min_score).withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_sentences)
    chosen = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "unit"))).alias("us"), F.array_sort(F.collect_set("marker")).alias("ms"))
    out = prompts.select("qid").join(chosen, "qid", "left")
    marks = F.transform("ms", lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]")))
    text = F.concat(F.array_join(F.transform("us", lambda u: u["unit"]), " "), F.lit(" "), F.array_join(marks, " "))
    return out.select(
        "qid", F.coalesce(text, F.lit(ABSTAIN_TEXT)).alias("text"), F.coalesce(text, F.lit("")).alias("raw_text"),
        F.coalesce(F.transform("ms", lambda m: m.cast("string")), F.array().cast("array<string>")).alias("citations"), F.col("us").isNull().alias("abstained"),
    )


def parse_citations(answers: DataFrame, prompts: DataFrame, remove: bool = False) -> DataFrame:
    """K1: markers become chunk ids, once each in order; numbers out of range go to invalid_citations."""
    rows = answers.drop("citations").join(prompts.select("qid", "context_chunk_ids"), "qid")
    numbers = F.transform(F.regexp_extract_all("text", F.lit(CITATION), 1), lambda m: F.coalesce(m.try_cast("int"), F.lit(0)))
    rows = rows.withColumn("_n", numbers)
    valid = F.filter(F.transform("_n", lambda n: F.get("context_chunk_ids", n - 1)), lambda c: c.isNotNull())
    invalid = F.filter("_n", lambda n: (n < 1) | (n > F.size("context_chunk_ids")))
    rows = rows.withColumn("citations", F.array_distinct(valid)).withColumn("invalid_citations", invalid)
    return (rows.withColumn("text", strip(F.regexp_replace("text", CITATION, ""))) if remove else rows).drop("_n", "context_chunk_ids")


def abstain_on_phrase(answers: DataFrame, phrases: tuple[str, ...] = ABSTAIN_PHRASES) -> DataFrame:
    """K2: an answer with one of the phrases abstains; abstention is never taken back."""
    bare = strip(F.regexp_replace("text", CITATION, ""))
    said = F.lit(False)
    for p in phrases:
        said = said | F.contains(bare, F.lit(p))
    return answers.withColumn("abstained", F.col("abstained") | said)


def abstain_without_citation(answers: DataFrame, message: str = ABSTAIN_TEXT) -> DataFrame:
    """K3, after K1: an answer that cites nothing gives way to the message."""
    bare = ~F.col("abstained") & (F.size("citations") == 0)
    rows = answers.withColumn("_b", bare)
    return rows.withColumns({"raw_text": F.when(F.col("_b"), F.col("text")).otherwise(F.col("raw_text")), "text": F.when(F.col("_b"), F.lit(message)).otherwise(F.col("text")), "abstained": F.col("abstained") | F.col("_b")}).drop("_b")


class ChatClient:
    """One connection's worth of settings for an OpenAI-compatible service."""

    def __init__(self, base_url: str, model: str, temperature: float = 0.0, max_tokens: int = 512, seed: int | None = 42, top_p: float | None = None, timeout: float = 120.0, api_key: str = "", extra_body: dict | None = None):
        self.base_url, self.model, self.timeout, self.api_key = base_url.rstrip("/"), model, timeout, api_key
        self.options = {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens), ("seed", seed), ("top_p", top_p)) if v is not None}
        self.extra = extra_body or {}

    def _call(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url + path, None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except (urllib.error.URLError, OSError, ValueError) as error:
            raise RuntimeError(f"{self.base_url}{path}: {error}") from error

    def payload(self, messages: list[dict], schema: dict | None = None) -> dict:
        body = {"model": self.model, "messages": messages} | self.options
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
        return body | self.extra

    def complete(self, messages: list[dict], schema: dict | None = None) -> dict:
        began = time.perf_counter()
        reply = self._call("/chat/completions", self.payload(messages, schema))
        choice = reply["choices"][0]
        text = (choice["message"].get("content") or "").strip()
        valid = None
        if schema:
            try:
                json.loads(text)
                valid = True
            except ValueError:
                valid = False
        usage = reply.get("usage") or {}
        return {"text": text, "raw_text": text, "schema_valid": valid, "model": reply.get("model", self.model), "finish_reason": choice.get("finish_reason"), "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"), "latency_ms": (time.perf_counter() - began) * 1000}

    def list_models(self) -> list[str]:
        return [m["id"] for m in self._call("/models").get("data", [])]

    def health_check(self) -> bool:
        try:
            return bool(self.list_models() is not None)
        except RuntimeError:
            return False

    def describe(self) -> dict:
        return {"generator": "openai_compat", "model": self.model, "base_url": self.base_url} | self.options


def generated(prompts: DataFrame, client: ChatClient, concurrency: int = 4, schema: dict | None = None) -> DataFrame:
    """G2 over a table: at most `concurrency` tasks call the service at once. Write the result before using it twice."""
    fields = "qid string, text string, raw_text string, schema_valid boolean, model string, finish_reason string, prompt_tokens int, completion_tokens int, latency_ms double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"qid": q} | client.complete([{"role": m["role"], "content": m["content"]} for m in ms], schema) for q, ms in zip(batch["qid"], batch["messages"], strict=True)]
            if rows:
                yield pd.DataFrame(rows)

    out = prompts.select(F.col("qid").cast("string").alias("qid"), "messages").repartition(concurrency).mapInPandas(run, fields)
    return out.withColumns({"abstained": F.lit(False), "citations": F.array().cast("array<string>")})


