"""Chunkers: fixed windows (C1) in DataFrame functions, recursive separators (C2, C3) in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "）", "」", "、", " ", "")
PIECE = "array<struct<text: string, char_start: int>>"


def _chunked(docs: DataFrame, pieces: str) -> DataFrame:
    """From an array of (text, char_start) to one row each; other columns of docs are inherited (C4)."""
    names = [c for c in docs.columns if c not in (pieces, "text", "char_start", "char_end", "n_chars", "chunk_ord", "chunk_id")]
    out = docs.select(*names, F.posexplode(pieces).alias("chunk_ord", "_p"))
    number = F.lpad(F.col("chunk_ord").cast("string"), 4, "0")
    wide = F.when(F.col("chunk_ord") > 9999, F.col("chunk_ord").cast("string")).otherwise(number)
    size = F.length("_p.text")
    return out.select(
        *names, F.concat(F.col("doc_id").cast("string"), F.lit("#c"), wide).alias("chunk_id"), "chunk_ord", F.col("_p.text").alias("text"),
        F.col("_p.char_start").cast("int").alias("char_start"), (F.col("_p.char_start") + size).cast("int").alias("char_end"), size.cast("int").alias("n_chars"),
    )


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of `size` characters every `size - overlap`; blank windows take no ordinal."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step, n = size - overlap, F.length("text")
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda k: F.struct(F.substring(F.col("text"), k * step + 1, F.lit(size)).alias("text"), (k * step).alias("char_start")))
    return _chunked(docs.withColumn("_pieces", F.filter(cut, lambda p: p["text"].rlike(r"(?U)\S"))), "_pieces")


Span = tuple[int, int]


def split_spans(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[Span]:
    """C2's first half: the text cut at the coarsest separator that makes pieces of at most `size`, as places in it. A
    piece keeps the separator that ends it; blank pieces are left out."""
    out: list[Span] = []
    todo = [(0, len(text), 0)]
    while todo:
        low, high, level = todo.pop()
        if not text[low:high].strip():
            continue
        if high - low <= size or level == len(separators):
            out.append((low, high))
        elif not (mark := separators[level]):
            todo += [(k, min(k + size, high), len(separators)) for k in reversed(range(low, high, size))]
        else:
            cuts = [low, *(m.end() for m in re.finditer(re.escape(mark), text[:high][low:])), high - low]
            ends = [low + c for c in cuts[1:]]
            todo += [(s, e, level + 1) for s, e in reversed(list(zip([low, *ends], ends, strict=False))) if s < e]
    return out


def _tail(spans: list[Span], n: int) -> list[Span]:
    """The last n characters of what the spans hold."""
    out: list[Span] = []
    for low, high in reversed(spans):
        if n <= 0:
            break
        out.insert(0, (max(low, high - n), high))
        n -= high - low
    return out


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int]]:
    """C2 and C3 for one text: (chunk, start). Places are carried along from the split; a chunk in which a blank piece is
    missing is no stretch of the text and starts where the one before it, less the overlap, ends. A chunk may exceed the
    size by the overlap that it repeats."""
    groups: list[list[Span]] = []
    held = 0
    for low, high in split_spans(text, size, separators):
        if not groups or held + high - low > size:
            groups.append(_tail(groups[-1], overlap) if groups else [])
            held = sum(e - s for s, e in groups[-1])
        own = groups[-1]
        if own and own[-1][1] == low:
            own[-1] = (own[-1][0], high)
        else:
            own.append((low, high))
        held += high - low
    out, after = [], 0
    for own in groups:
        chunk = "".join(text[s:e] for s, e in own)
        start = own[0][0] if len(own) == 1 else after
        out.append((chunk, start))
        after = start + max(len(chunk) - overlap, 1)
    return out


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """C2 with offsets by C3."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    at = docs.columns.index("text")
    piece = pa.list_(pa.struct([("text", pa.string()), ("char_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"text": t, "char_start": s} for t, s in recursive_pieces(x or "", size, overlap, separators)] for x in batch.column(at).to_pylist()]
            yield batch.append_column("_pieces", pa.array(rows, piece))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _chunked(docs.mapInArrow(run, f"{schema}, _pieces {PIECE}"), "_pieces")
