"""Text functions on columns: normal forms, n-grams, token estimates, splitting. All but NFKC, what follows it directly and quotes
stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Fixed values.
ANSWER_PUNCTUATION = r"""[。、．，・：；！？「」『』（）〔〕［］｛｝〈〉《》【】\"'`()\[\]{}<>:;!?,.…‥~〜ー–—\-_/\\|＋+*=＝]"""
TOKEN_NOISE = r"^[\s　。、，．・！？（）「」『』【】〔〕：；…‥\-—–_/\\|]+$"
LIST_SEPARATORS = r"[、,，\n・]|(?<![0-9])\.(?![0-9])"
UNIT_SPLIT = r"(?<=[。！？!?])|\n+"
MARKDOWN_HEADING = r"^\s*#{1,6}\s"
LIST_MARKER = r"^\s*(?:[-*・]|\d+[.)])\s*"
DRAFT_SENTENCE = r"[^。！？\n]+[。！？]?"
#: Segments up to this length are cut by substrings, which is faster for words and quadratic beyond them.
SHORT = 500
QUOTE_MIN, QUOTE_MAX = 12, 40
ASCII_TOKENS, OTHER_TOKENS = 0.3, 1.1
#: Texts of a batch that are strings in Python at once.
TEXTS = 256
#: What \\s stands for in Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE, _PUNCTUATION, _SENTENCE = re.compile(f"[{WHITE_SPACE}]+"), re.compile(ANSWER_PUNCTUATION + "+"), re.compile(DRAFT_SENTENCE)
_ASCII_PUNCTUATION = bytes(c for c in range(128) if _PUNCTUATION.match(chr(c)))


def _by_parts(of: Callable[[str], str | None]) -> Callable[..., Column]:
    """A column function of a string function. Only TEXTS texts of a batch are strings in Python at once."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else of(t) for t in texts.slice(low, TEXTS).to_pylist()], pa.string()) for low in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


_nfkc = _by_parts(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode normal form KC. Spark has no built-in for it, so texts pass through Arrow once."""
    return _nfkc(text)


def flat(text: str, unicode: bool = True) -> str:
    """T7 for one string. `split` is several times faster than a pattern, but also cuts at four control characters."""
    text = text if not unicode or text.isascii() else unicodedata.normalize("NFKC", text)
    return _WHITE.sub("", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else "".join(text.split())


def _bare(text: str) -> str:
    """T8 for one string, before case folding."""
    text = flat(text)
    return text.encode().translate(None, _ASCII_PUNCTUATION).decode() if text.isascii() else _PUNCTUATION.sub("", text)


_flat = _by_parts(flat)


_without_punctuation = _by_parts(_bare)


def quote_of(text: str) -> str | None:
    """T14 for one string; sentences are cut until one is long enough."""
    whole = text.strip(WHITE_SPACE)
    body = whole.partition("\n")[2].strip(WHITE_SPACE) or whole
    sentences = (m.group().strip(WHITE_SPACE) for m in _SENTENCE.finditer(body))
    return next((s[:QUOTE_MAX] for s in sentences if len(s) >= QUOTE_MIN), body[:QUOTE_MAX] if len(body) >= QUOTE_MIN else None)


_quote = _by_parts(quote_of)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def casefold(text: Column) -> Column:
    """Lower case, and the letters that folding maps further: sharp s, final sigma, long s."""
    folded = F.lower(text)
    for letter, plain in (("ς", "σ"), ("ſ", "s"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def normalize_for_match(text: Column, unicode: bool = True) -> Column:
    """NFKC without any white space."""
    return _flat(text) if unicode else F.regexp_replace(text, r"(?U)\s+", "")


def normalize_answer(text: Column, unicode: bool = True) -> Column:
    """T7 without punctuation, case folded."""
    return casefold(_without_punctuation(text) if unicode else F.regexp_replace(normalize_for_match(text, False), ANSWER_PUNCTUATION, ""))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: inside a lambda an outer expression is computed again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grams_of(segment: Column, n: int) -> Column:
    """All n-grams of a string in order; none where it is shorter. Linear in the length, unlike repeated substrings."""
    none = F.array().cast("array<string>")

    def cut(chars: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, each).otherwise(none)

    return let(F.filter(F.split(segment, ""), lambda c: c != ""), cut)


def token_ngrams(text: Column, n: int = 2, unicode: bool = True) -> Column:
    """N-grams inside white-space segments, lower case, noise segments left out; a multiset."""
    segments = F.filter(F.split(F.lower(nfkc(text) if unicode else text), r"(?U)\s+"), lambda s: (s != "") & ~s.rlike("(?U)" + TOKEN_NOISE))
    short = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
    return F.flatten(F.transform(segments, lambda s: F.when(F.length(s) < n, F.array(s)).when(F.length(s) <= SHORT, short(s)).otherwise(grams_of(s, n))))


def ngram_set(text: Column, n: int = 3, unicode: bool = True) -> Column:
    """T4, and T5 with n = 2: distinct n-grams without white space; a shorter text is its own gram, an empty one none."""
    none = F.array().cast("array<string>")
    return let(normalize_for_match(text, unicode), lambda flat: F.when(flat == "", none).when(F.length(flat) < n, F.array(flat)).otherwise(F.array_distinct(grams_of(flat, n))))


def hashing_grams(text: Column, n: int = 2) -> Column:
    """A multiset over the text without white space, neither normalised nor lower-cased."""
    return grams_of(F.regexp_replace(text, r"(?U)\s+", ""), n)


def token_estimate(text: Column) -> Column:
    """floor(0.3 per ASCII character + 1.1 per other) + 1."""
    size, other = F.length(text), F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.floor((size - other) * F.lit(ASCII_TOKENS) + other * F.lit(OTHER_TOKENS)) + 1).cast("int")


def token_count(text: Column, tokenizer_path: str | None = None) -> Column:
    """Struct of n and method: exact by a tokenizer file where it and its library can be read, else the estimate."""
    estimate = F.struct(token_estimate(text).alias("n"), F.lit("estimate").alias("method"))
    try:
        from tokenizers import Tokenizer

        Tokenizer.from_file(tokenizer_path or "")
    except Exception:  # noqa: BLE001  any fault means the estimate, which the method says
        return estimate

    @F.pandas_udf(IntegerType())
    def exact(texts: pd.Series) -> pd.Series:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        return texts.map(lambda t: None if t is None else len(tokenizer.encode(t, add_special_tokens=False).ids)).astype("Int32")

    return F.struct(exact(text).alias("n"), F.lit("tokenizer").alias("method"))


def tokens(text: Column, name: str = "char_ngram", **options) -> Column:
    """Tokens by a tokenizer's name; T2, morphemes, needs a library that is not part of the engine."""
    if name == "char_ngram":
        return token_ngrams(text, **options)
    if name == "sudachi":
        raise ImportError("tokenizer 'sudachi' needs SudachiPy and a dictionary; use 'char_ngram'")
    raise ValueError(f"unknown tokenizer {name!r}; known: char_ngram, sudachi")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_items(text: Column) -> Column:
    """T11."""
    return _kept(F.split(text, LIST_SEPARATORS))


def answer_items(answer: Column, answer_type: Column) -> Column:
    """A list answer's items, or the answer alone."""
    return F.when(answer_type == "list", F.transform(F.split(F.replace(answer, F.lit("、"), F.lit(",")), ","), strip)).otherwise(F.array(answer))


def sentence_units(text: Column, skip_headings: bool = True) -> Column:
    """T13."""
    units = _kept(F.split(text, UNIT_SPLIT))
    if skip_headings:
        units = F.filter(units, lambda u: ~u.rlike(MARKDOWN_HEADING))
    return F.transform(units, lambda u: F.regexp_replace(u, LIST_MARKER, ""))


def pick_quote(text: Column) -> Column:
    """The first long enough sentence after the first line, cut; else the body, cut; else null."""
    return _quote(text)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def answer_key(qid: Column, text: Column) -> Column:
    """T16."""
    return F.concat_ws("\t", qid, normalize_answer(text))
