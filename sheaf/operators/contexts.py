"""Context operators per question (O1 to O4) and prompt construction.

Contexts are rows (qid, pos, chunk_id, score, text, section_path, page); `pos` from 1 is the order that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import flat, token_estimate
from sheaf.sources.grouped import whole_groups

#: Bytes of the matrix of texts and their grams that a task holds at once; a number above all characters.
SHARED_BYTES, NO_CHARACTER = 16 << 20, 0x1FFFFF
#: Fixed values.
SECTION_TEMPLATE = ("【", "】\n")
SYSTEM_MARK, USER_MARK, QUESTION_MARK = "<<<SYSTEM>>>", "<<<USER>>>", "# 質問"
INSTRUCTIONS = (
    "あなたは提供された参考文書のみに基づいて質問に答えるアシスタントです。\n\n規則:\n- 参考文書に書かれていることだけを使って答える。推測で補わない。\n"
    "- 参考文書に答えが無い場合は、必ず「分かりません」とだけ答える。\n- 根拠にした参考文書の番号を、回答の末尾に [1] [3] の形式で示す。\n- 回答は簡潔にする。前置きや言い換えを入れない。"
)
CONTEXT = "struct<pos: int, chunk_id: string, score: double, text: string, section_path: string, page: int>"


def from_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The contexts of ranked hits."""
    extra = [F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in (("section_path", "string"), ("page", "int"))]
    return hits.select("qid", F.col("rank").alias("pos"), "chunk_id", "score").join(chunks.select("chunk_id", "text", *extra), "chunk_id").select("qid", "pos", "chunk_id", "score", "text", "section_path", "page")


def _renumbered(contexts: DataFrame, *order: Column) -> DataFrame:
    return contexts.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def top_k(contexts: DataFrame, k: int) -> DataFrame:
    """O1: the first k in the order that they have."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _renumbered(contexts, F.col("pos")).where(F.col("pos") <= k)


def reorder_lost_in_middle(contexts: DataFrame) -> DataFrame:
    """O2: best first and second best last, the worst in the middle."""
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "pos")
    r, n = F.row_number().over(by_score) - 1, F.count(F.lit(1)).over(Window.partitionBy("qid"))
    keyed = contexts.withColumn("_r", r).withColumn("_key", F.when(F.col("_r") % 2 == 0, F.col("_r")).otherwise(2 * n - F.col("_r")))
    return _renumbered(keyed, F.col("_key")).drop("_r", "_key")


def _gram_codes(text: str, n: int, numbers: dict[str, int]) -> np.ndarray:
    """The distinct n-grams of a string as numbers: up to three characters packed, longer ones by a common dictionary."""
    if not text:
        return np.zeros(0, np.int64)
    if n > 3:
        return np.array(sorted({numbers.setdefault(text[i : i + n], len(numbers)) for i in range(max(len(text) - n, 0) + 1)}), np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < n:
        points = np.append(points, np.full(n - len(points), NO_CHARACTER))
    code = points[: len(points) - n + 1]
    for k in range(1, n):
        code = code << 21 | points[k : len(points) - n + 1 + k]
    return np.unique(code)


def _shared(rows: np.ndarray, number: np.ndarray, m: int, low: int, high: int) -> np.ndarray:
    """How many grams each of the texts low to high shares with each of all m, a bounded block of grams at a time. Each
    entry is a text and a gram, sorted by gram."""
    out = np.zeros((high - low, m), np.float32)
    step = max(1, SHARED_BYTES // (4 * m))
    n_grams, at = int(number[-1]) + 1 if len(number) else 0, 0
    for first in range(0, n_grams, step):
        end = np.searchsorted(number, first + step)
        held = np.zeros((m, min(step, n_grams - first)), np.float32)
        held[rows[at:end], number[at:end] - first] = 1
        out += held[low:high] @ held.T
        at = end
    return out


def _kept(texts: list[str], threshold: float, n: int) -> list[int]:
    """The fold of O3 over the texts of a question in their order."""
    numbers: dict[str, int] = {}
    codes = [_gram_codes(t, n, numbers) for t in texts]
    sizes, m = np.array([len(c) for c in codes]), len(texts)
    grams = np.concatenate(codes)
    order = np.argsort(grams, kind="stable")
    number = np.cumsum(np.concatenate([[0], np.diff(grams[order]) != 0])) if len(grams) else grams
    rows = np.repeat(np.arange(m), sizes)[order]
    common = np.concatenate([[False], number[1:] == number[:-1]]) if len(grams) else np.zeros(0, bool)
    common[:-1] |= common[1:].copy()  # a gram of one text is shared with none
    rows, number = rows[common], number[common]
    number = np.cumsum(np.concatenate([[0], np.diff(number) != 0])) if len(number) else number
    kept: list[int] = []
    for low in range(0, m, 256):
        high = min(m, low + 256)
        both = _shared(rows, number, m, low, high).astype(float)
        near = (both >= (sizes[low:high, None] + sizes - both) * threshold) & (sizes[low:high, None] > 0) & (sizes > 0)
        for k in range(low, high):
            if not near[k - low, kept].any():
                kept.append(k)
    return kept


def dedupe(contexts: DataFrame, threshold: float = 0.9, n: int = 3, unicode: bool = True) -> DataFrame:
    """O3: in score order, without those whose n-grams overlap with an already kept one by the threshold. A fold, since
    each decision depends on the ones before; a question's few contexts are its state, shared grams are counted at once."""
    fields = ", ".join(f"`{f.name}` {'int' if f.name == 'pos' else f.dataType.simpleString()}" for f in contexts.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every, starts in whole_groups(batches, ["qid"], 1024):
            text, found, places = every.column("text"), [], []
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), every.num_rows], strict=True):
                own = _kept([flat(t or "", unicode) for t in text[low:high].to_pylist()], threshold, n)
                found += [low + k for k in own]
                places += range(1, len(own) + 1)
            out = every.take(pa.array(found, pa.int64()))
            yield pa.record_batch([pa.array(places, pa.int32()) if c == "pos" else out.column(c) for c in out.schema.names], names=out.schema.names)

    ordered = contexts.repartition("qid").sortWithinPartitions("qid", (-F.col("score")).asc_nulls_first(), "pos", "chunk_id")
    return ordered.mapInArrow(run, fields)


def add_section_path(contexts: DataFrame) -> DataFrame:
    """O4."""
    head = F.concat(F.lit(SECTION_TEMPLATE[0]), "section_path", F.lit(SECTION_TEMPLATE[1]))
    return contexts.withColumn("text", F.when(F.col("section_path").isNotNull() & (F.col("section_path") != ""), F.concat(head, "text")).otherwise(F.col("text")))


def within_budget(contexts: DataFrame, budget: int | None, policy: str = "drop_lowest", all_questions: DataFrame | None = None) -> DataFrame:
    """B1, B2: (qid, contexts, n_dropped, n_truncated). In presentation order, what doesn't fit is skipped and later
    ones may still fit; `truncate_each` cuts the first that overflows to what is left."""
    row = F.struct("pos", "chunk_id", "score", "text", "section_path", "page")
    grouped = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(row)).cast(f"array<{CONTEXT}>").alias("rows"))
    if all_questions is not None:
        grouped = all_questions.select("qid").join(grouped, "qid", "left").withColumn("rows", F.coalesce("rows", F.array().cast(f"array<{CONTEXT}>")))
    if budget is None:
        return grouped.select("qid", F.col("rows").alias("contexts"), F.lit(0).alias("n_dropped"), F.lit(0).alias("n_truncated"))
    state = f"struct<kept: array<{CONTEXT}>, used: int, dropped: int, truncated: int>"

    def step(acc: Column, x: Column) -> Column:
        cost, left = token_estimate(x["text"]), F.lit(budget) - acc["used"]
        keep = F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["used"] + cost).alias("used"), acc["dropped"].alias("dropped"), acc["truncated"].alias("truncated")).cast(state)
        drop = F.struct(acc["kept"].alias("kept"), acc["used"].alias("used"), (acc["dropped"] + 1).alias("dropped"), acc["truncated"].alias("truncated")).cast(state)
        if policy == "drop_lowest":
            return F.when(cost <= left, keep).otherwise(drop)
        size = F.greatest(F.floor(F.length(x["text"]) * left / cost), F.lit(1)).cast("int")
        part = F.struct(x["pos"].alias("pos"), x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), F.substring(x["text"], F.lit(1), size).alias("text"), x["section_path"].alias("section_path"), x["page"].alias("page"))
        cut = F.struct(F.concat(acc["kept"], F.array(part)).alias("kept"), F.lit(budget).alias("used"), acc["dropped"].alias("dropped"), (acc["truncated"] + 1).alias("truncated")).cast(state)
        return F.when(cost <= left, keep).when(left > 0, cut).otherwise(drop)

    if policy not in ("drop_lowest", "truncate_each"):
        raise ValueError(f"unknown policy {policy}")
    start = F.struct(F.array().cast(f"array<{CONTEXT}>").alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("dropped"), F.lit(0).alias("truncated")).cast(state)
    folded = grouped.withColumn("f", F.aggregate("rows", start, step))
    return folded.select("qid", F.col("f.kept").alias("contexts"), F.col("f.dropped").alias("n_dropped"), F.col("f.truncated").alias("n_truncated"))


def context_views(budgeted: DataFrame) -> DataFrame:
    """Numbered from 1 after the budget."""
    return budgeted.select("qid", F.posexplode("contexts").alias("i", "c")).select("qid", (F.col("i") + 1).alias("number"), "c.chunk_id", "c.text", "c.page", "c.section_path", F.round("c.score", 4).alias("score"))


def user_message(question: Column, contexts: Column) -> Column:
    """The user's part of the prompt. A context's head line runs straight into its text, as block tags take their
    newline with them; an unmarked head leaves just the number."""

    def one(c: Column, i: Column) -> Column:
        section = F.when(F.coalesce(c["section_path"], F.lit("")) != "", F.concat(F.lit(" （"), c["section_path"], F.lit("）"))).otherwise(F.lit(""))
        page = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(F.lit(" p."), c["page"].cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), section, page, F.lit("\n"), c["text"], F.lit("\n\n"))

    return F.concat(F.lit("# 参考文書\n\n"), F.array_join(F.transform(contexts, one), ""), F.lit(QUESTION_MARK + "\n\n"), question)


def split_prompt(rendered: Column) -> Column:
    """(system, user) of a rendered template; without marks all of it is the user's."""
    after_system = F.element_at(F.split(rendered, SYSTEM_MARK, 2), -1)
    parts = F.split(after_system, USER_MARK, 2)
    marked = F.contains(rendered, F.lit(USER_MARK))
    system = F.when(marked & F.contains(rendered, F.lit(SYSTEM_MARK)), F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"(?U)^\s+|\s+$", ""))).otherwise(F.lit(""))
    return F.struct(system.alias("system"), F.regexp_replace(F.when(marked, F.element_at(parts, -1)).otherwise(rendered), r"(?U)^\s+|\s+$", "").alias("user"))


def messages(system: Column, user: Column, placement: str = "system") -> Column:
    """B6."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if placement == "user":
        return F.array(message("user", F.when(system == "", user).otherwise(F.concat(system, F.lit("\n\n"), user))))
    return F.when(system == "", F.array(message("user", user))).otherwise(F.array(message("system", system), message("user", user)))


def prompts(questions: DataFrame, contexts: DataFrame, budget: int | None = 1536, policy: str = "drop_lowest", placement: str = "system", instructions: str = INSTRUCTIONS) -> DataFrame:
    """(qid, question, contexts, messages, context_chunk_ids, token_estimate, n_dropped, n_truncated) of each question."""
    rows = questions.select("qid", "question").join(within_budget(contexts, budget, policy, questions), "qid")
    made = rows.withColumn("messages", messages(F.lit(instructions), user_message(F.col("question"), F.col("contexts")), placement))
    total = F.aggregate(F.transform("messages", lambda m: token_estimate(m["content"])), F.lit(0), lambda a, x: a + x)  # B7
    return made.withColumn("context_chunk_ids", F.transform("contexts", lambda c: c["chunk_id"])).withColumn("token_estimate", total)
