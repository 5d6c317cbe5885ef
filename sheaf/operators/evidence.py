"""Evidence resolution: quoted, paged and sectioned evidence to chunks (X1 to X9), gold checks.

chunks: (chunk_id, doc_id, chunk_ord, text, char_start, page, page_start, page_end, section_path); evidence: (qid, ev_ord,
quote, page, section_path).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import normalize_for_match
from sheaf.sources.scratch import stored

#: Characters of quotes that a task holds at once.
MAX_CHARS = 32 << 20
#: Texts of a batch that are strings in Python at once.
TEXTS = 256


def exploded(gold: DataFrame) -> DataFrame:
    """The evidence rows of answerable gold items."""
    return gold.where("answerable").select("qid", F.posexplode("evidence").alias("ev_ord", "e")).select("qid", "ev_ord", "e.quote", "e.page", "e.section_path")


def _finder(needles: list[str]):
    """All needles that a text holds: one pass over the text where the automaton library is there, else one a needle."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [n for n in needles if n in text]
    automaton = ahocorasick.Automaton()
    for n in needles:
        automaton.add_word(n, n)
    automaton.make_automaton()
    return lambda text: {n for _, n in automaton.iter(text)}


def substring_pairs(texts: DataFrame, needles: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(text columns, needle columns) where `norm` holds `needle`. Tasks get the distinct needles, whose size is
    checked: beyond `max_chars` characters they go in blocks. Each text is read once a block; no pairs are tried."""
    needles = needles.where(F.coalesce("needle", F.lit("")) != "")
    distinct = needles.select("needle").distinct()
    total = distinct.agg(F.sum(F.length("needle"))).first()[0] or 0
    blocks = max(1, -(-total // max_chars))
    at = texts.columns.index("norm")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "norm") + ", needle string"
    found: DataFrame | None = None
    for b in range(blocks):
        own = [r[0] for r in distinct.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()]

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            find = _finder(own) if own else lambda text: ()
            for batch in batches:
                for low in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(low, TEXTS)
                    hits = [(k, n) for k, text in enumerate(part.column(at).to_pylist()) if text for n in find(text)]
                    if hits:
                        rows = part.drop_columns(["norm"]).take(pa.array([k for k, _ in hits], pa.int64()))
                        yield rows.append_column("needle", pa.array([n for _, n in hits], pa.string()))

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.join(needles, "needle")


def _on_page(page: str = "page") -> F.Column:
    start = F.coalesce("c_page_start", "c_page")
    return F.coalesce((F.col(page) >= start) & (F.col(page) <= F.coalesce("c_page_end", start)), F.lit(False))


def resolve(evidence: DataFrame, chunks: DataFrame, page_fallback: bool = True, unicode: bool = True) -> DataFrame:
    """(qid, ev_ord, anchor, quote_status, chunk_ids)."""
    c = chunks.select("chunk_id", "doc_id", *[F.col(x).alias(f"c_{x}") for x in ("page", "page_start", "page_end", "section_path", "chunk_ord", "char_start")], "text", normalize_for_match(F.coalesce("text", F.lit("")), unicode).alias("norm"))
    c = stored(c, "chunks")  # read by each anchor
    e = evidence.withColumn("needle", normalize_for_match(F.coalesce("quote", F.lit("")), unicode)).withColumn("sect", normalize_for_match(F.coalesce("section_path", F.lit("")), unicode))
    anchor = F.when(F.coalesce("quote", F.lit("")) != "", "quote").when(F.col("page").isNotNull(), "page").when(F.coalesce("section_path", F.lit("")) != "", "section_path")
    e = e.withColumn("anchor", anchor)
    key = ["qid", "ev_ord"]

    quoted = e.where("anchor = 'quote'")
    hits = substring_pairs(c.drop("text", "c_section_path"), quoted.select(*key, "needle", "page")).withColumn("on_page", F.col("page").isNotNull() & _on_page())
    any_on = F.max("on_page").over(Window.partitionBy(*key))
    narrowed = hits.withColumn("_any", any_on).where("on_page or not _any").select(*key, "chunk_id").withColumn("status", F.lit("found"))

    unresolved = quoted.join(narrowed.select(*key).distinct(), key, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("c_chunk_ord", "c_char_start", "text")))
    # without the characters that a chunk repeats from the one before
    joined = F.aggregate("parts", F.struct(F.lit("").alias("t"), F.lit(0).alias("end")), lambda a, x: F.struct(
        F.concat(a["t"], F.substring(x["text"], F.greatest(a["end"] - x["c_char_start"], F.lit(0)) + 1, F.length(x["text"]))).alias("t"),
        F.greatest(a["end"], x["c_char_start"] + F.length(x["text"])).alias("end")))["t"]
    whole = c.groupBy("doc_id").agg(ordered.alias("parts")).select("doc_id", normalize_for_match(joined, unicode).alias("norm"))
    split = substring_pairs(whole, unresolved.select(*key, "needle")).select(*key).distinct().withColumn("split", F.lit(True))
    status = F.when(F.col("needle") == "", F.lit("missing_from_corpus")).when(F.coalesce("split", F.lit(False)), F.lit("split_across_chunks")).otherwise(F.lit("missing_from_corpus"))
    failed = unresolved.join(split, key, "left").select(*key, "page", status.alias("status"))

    by_page = e.where("anchor = 'page'").select(*key, "page", F.lit(None).cast("string").alias("status"))
    if page_fallback:
        by_page = by_page.unionByName(failed.where("page is not null"))
    # a range join: chunks are listed under each page that they span
    pages = c.withColumn("_from", F.coalesce("c_page_start", "c_page")).where("_from is not null").select("chunk_id", F.explode(F.sequence("_from", F.greatest("_from", F.coalesce("c_page_end", "_from")))).alias("page"))
    paged = by_page.join(pages, "page").select(*key, "chunk_id", "status")

    sections = e.where("anchor = 'section_path' and sect <> ''").select(*key, F.col("sect").alias("needle"))
    by_section = c.select("chunk_id", normalize_for_match(F.coalesce("c_section_path", F.lit("")), unicode).alias("norm"))
    sectioned = substring_pairs(by_section, sections).select(*key, "chunk_id").withColumn("status", F.lit(None).cast("string"))

    found = narrowed.unionByName(paged).unionByName(sectioned).groupBy(*key).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.max("status").alias("status"))
    fell = F.when((F.col("anchor") == "quote") & (F.coalesce("f.status", F.lit("found")) != "found") & F.col("chunk_ids").isNotNull(), F.lit("page")).otherwise(F.col("anchor"))
    out = e.alias("e").join(found.alias("f"), key, "left").join(failed.select(*key, F.col("status").alias("failure")), key, "left")
    return out.select(*key, fell.alias("anchor"), F.when(F.col("e.anchor") == "quote", F.coalesce("f.status", "failure")).alias("quote_status"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def resolution_report(matches: DataFrame) -> DataFrame:
    """Counts by status and the share of quotes that resolve; null without quotes."""
    count = lambda s: F.count_if(F.col("quote_status") == s).alias(s)
    rate = F.round(F.try_divide(F.count_if(F.col("quote_status") == "found"), F.count("quote_status")), 4)
    return matches.agg(count("found"), count("split_across_chunks"), count("missing_from_corpus"), rate.alias("resolvability"))


def unmeasurable(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """Answerable questions without any gold chunk."""
    measured = matches.where(F.size("chunk_ids") > 0).select("qid").distinct()
    return gold.where("answerable").select("qid").join(measured, "qid", "left_anti").orderBy("qid")


def verify_quotes(matches: DataFrame) -> DataFrame:
    """Evidence whose quote is not in a chunk, with what to do about it."""
    hint = F.when(F.col("quote_status") == "split_across_chunks", "shorten the quote so that it lies in one chunk").otherwise("compare the quote with the text as extracted")
    return matches.where("quote_status is not null and quote_status <> 'found'").select("qid", "ev_ord", "quote_status", hint.alias("hint"))


def todo_questions(gold: DataFrame) -> DataFrame:
    """X10."""
    return gold.where("question like '%TODO%' or answer like '%TODO%' or question is null or not question rlike '(?U)\\\\S'").select("qid").orderBy("qid")


def gold_summary(gold: DataFrame) -> DataFrame:
    """X11: per question type and in total: items, unanswerable ones, their share."""
    return gold.groupingSets([["question_type"], []], "question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("answerable")).alias("n_unanswerable"), F.round(F.avg((~F.col("answerable")).cast("int")), 4).alias("unanswerable_ratio"), F.grouping("question_type").alias("is_total"))
