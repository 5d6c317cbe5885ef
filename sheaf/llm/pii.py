"""Personal data: base patterns, and spans that a bidirectional LSTM with CRF transitions adds.

The tagger is trained on labelled spans that `training_windows` writes from public formats: e-mail, IPv4, card and phone
numbers as the patterns know them and as they don't (spelled-out at and dot, bracketed dots, national phone numbers,
cards in groups with dots), and look-alikes without a label (dates, sums, book numbers, versions, hashes). A text is laid
out in windows of `WINDOW` characters that overlap by half. Scores of overlapping windows are averaged with weights that
fall towards window edges, and each text is decoded as one sequence, so that a span never ends at a window's edge. A
decoded span is added if it overlaps no base span and has what its kind can't be without (a Luhn sum, four numbers up to
255, an at, enough digits). Windows are run from the places of which such a span holds one (`_places`) outwards, until
places where no best path can leave O (`Tagger.outside`) lie on either side; what is between them is decoded by itself,
which gives the path of the whole text there. So the spans are those of running every window.

Defined cases: null text counts as empty and gives no span; spans are in code points, end exclusive; of base matches
those that fail their test are dropped without retries; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches
from .tagger import KINDS, PAD, Tagger, symbols

WINDOW = 64
STRIDE = WINDOW // 2
#: Characters of the short texts whose scores are worked out together.
TOGETHER = 1 << 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# matches begin where a run of digits does: starts within a run, which only cost time, are left out
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What every span has that `_substance` lets pass, and the characters of the shortest one.
_NEEDED, _LEAST = re.compile(r"[0-9@]|at|AT"), 5
_AT = re.compile(r"@|(?<![A-Za-z0-9])(?:at|AT)(?![A-Za-z0-9])")
#: From the first to the last digit of a stretch without letters.
_NUMBERS = re.compile(r"[0-9][^A-Za-z]*[0-9]")
_DOT = re.compile(r"\.|(?<![A-Za-z0-9])(?:dot|DOT)(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, found from each at sign instead of from each character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Ways to write an at sign, a dot in a host, the dots of an address, and the gaps of cards and phone numbers.
_ATS = ("@", "@", "@", "@", " @ ", "(@)", "(at)", " (at) ", "[at]", " [at] ", " at ")
_DOTS = (".", ".", " dot ", "[dot]", " (dot) ", "(.)")
_IP_DOTS = (".", ".", ".", "[.]", " . ", "(.)")
_CARD_GAPS = ("", " ", "-", ".", ".", " - ", "  ")


class _Writer:
    """Writes spans of the four kinds, and look-alikes, from one random stream."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, values):
        return values[int(self.r.integers(len(values)))]

    def digits(self, k: int) -> str:
        return "".join(str(d) for d in self.r.integers(0, 10, k))

    def letters(self, k: int) -> str:
        return "".join(chr(97 + c) for c in self.r.integers(0, 26, k))

    def word(self) -> str:
        if self.r.random() < 0.25:
            return self.pick(("the", "of", "at", "and", "dot", "in", "on", "a", "that", "tel", "card", "mail", "ip", "no"))
        own = self.letters(int(self.r.integers(1, 9)))
        return own.capitalize() if self.r.random() < 0.15 else own

    def email(self, ats=_ATS, dots=_DOTS) -> str:
        at = self.pick(ats)
        dot = "." if at == "@" else self.pick(dots)
        own = [self.letters(int(self.r.integers(2, 9)))]
        if self.r.random() < 0.5:
            own += [self.pick((dot, "_", "-", "+", ".")), self.pick((self.digits(2), self.letters(int(self.r.integers(2, 8)))))]
        host = self.letters(int(self.r.integers(2, 9))) + self.pick(("", "", "-" + self.letters(3), self.digits(1)))
        return "".join(own) + at + host + dot + self.pick(("com", "org", "net", f"example{dot}com", f"co{dot}uk", "de"))

    def ip(self, dots=_IP_DOTS) -> str:
        return self.pick(dots).join(str(int(x)) for x in self.r.integers(0, 256, 4))

    def card(self, gaps=_CARD_GAPS) -> str:
        k = int(self.pick((13, 15, 16, 16, 16, 19)))
        d = self.pick("3456") + self.digits(k - 2)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        gap = self.pick(gaps)
        return gap.join(d[i : i + 4] for i in range(0, k, 4))

    def phone(self, gaps=(" ", "-", ".")) -> str:
        gap, area, a, b = self.pick(gaps), self.digits(3), self.digits(3), self.digits(4)
        local = self.pick((f"({area}) {a}-{b}", f"{area}{gap}{a}{gap}{b}", f"({area}) {a}{gap}{b}", f"0{self.digits(3)}/{a}{b}", f"{self.digits(2)}{gap}{self.digits(4)}{gap}{b}"))
        return self.pick(("", "", "+1 ", "+49 ", "0044 ", "0049 ", "1-")) + local

    def other(self) -> str:
        """What looks like one of the kinds and is none."""
        d, pick = self.digits, self.pick
        return pick((
            lambda: d(int(self.r.integers(1, 7))), lambda: f"{d(1)}.{d(1)}.", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}", lambda: f"1{d(1)}.0{d(1)}.20{d(2)}",
            lambda: '"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)} %",
            lambda: "@" + self.word(), lambda: d(30), lambda: f"{d(2)} {d(3)} {d(3)} {d(3)} units", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: f"ISBN 978 {d(1)} {d(3)} {d(5)} {d(1)}",
            lambda: f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{self.word()} at {self.word()}", lambda: f"{self.word()} dot {self.word()}", lambda: f"pp. {d(3)}-{d(3)}", lambda: f"No. {d(8)}", lambda: f"{d(3)}.{d(3)} kg",
            lambda: f"EUR {d(3)}.{d(3)}", lambda: f"{d(4)}x{d(4)}", lambda: f"id={d(12)}",
        ))()


def training_windows(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up prose with labelled spans in many spellings, and look-alikes that carry no label."""
    w = _Writer(seed)
    r, pick = w.r, w.pick

    ids, labels = np.full((n, WINDOW), PAD, dtype=np.int8), np.zeros((n, WINDOW), dtype=np.int8)
    for row in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            x = r.random()
            if x < 0.12:
                kind = int(r.integers(4))
                span = (w.email, w.ip, w.card, w.phone)[kind]()
                marks.append((len(text), kind, len(text) + len(span)))
                text += span
            elif x < 0.24:
                text += w.other()
            else:
                text += w.word()
            text += pick([" ", " ", " ", " ", ", ", ".\n", ". ", "!! ", "%%% ", " | "])
        full = np.zeros(len(text), dtype=np.int8)
        for s, kind, e in marks:
            full[s:e] = 2 + 2 * kind
            full[s] = 1 + 2 * kind
        at = int(r.integers(0, WINDOW // 2))
        ids[row], own = symbols(text[at : at + WINDOW]), full[at : at + WINDOW].copy()
        if own[0] and own[0] % 2 == 0:  # a span that is cut at the window's start begins there
            own[0] -= 1
        labels[row] = own
    return ids, labels


@lru_cache(maxsize=1)
def trained() -> Tagger:
    tagger = Tagger()
    tagger.train(*training_windows())
    return tagger


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)


class _Scores:
    """The averaged scores of texts laid end to end, each in whole steps of STRIDE, worked out step by step as they are
    asked for: those of a step need the one or two windows over it. `block` windows go through the network at a time."""

    def __init__(self, texts: list[str], tagger: Tagger, block: int):
        self.tagger, self.block = tagger, block
        self.lengths = np.array([len(t) for t in texts])
        steps = np.maximum(2, -(-self.lengths // STRIDE))
        self.bounds = np.concatenate([[0], np.cumsum(steps)])
        n = int(self.bounds[-1])
        self.owner = np.repeat(np.arange(len(texts)), steps)
        self.ids = np.full((n, STRIDE), PAD, dtype=np.int8)
        for k, t in enumerate(texts):
            self.ids.reshape(-1)[self.bounds[k] * STRIDE :][: len(t)] = symbols(t)
        self.first, self.last = np.zeros(n, bool), np.zeros(n, bool)
        self.first[self.bounds[:-1]] = self.last[self.bounds[1:] - 1] = True
        self.total = np.zeros((len(tagger.p["o"]), n, STRIDE), np.float32)
        self.weight = np.zeros((n, STRIDE), np.float32)
        self.run, self.known = self.last.copy(), np.zeros(n, bool)  # windows by their first step: none begins at a text's last

    def learn(self, steps: np.ndarray) -> None:
        """Run the windows that these steps still lack."""
        windows = np.union1d(steps, steps[~self.first[steps]] - 1)
        windows = windows[~self.run[windows]]
        for at in range(0, len(windows), self.block):
            own = windows[at : at + self.block]
            scores = self.tagger.scored(np.concatenate([self.ids[own], self.ids[own + 1]], 1)).transpose(0, 2, 1)
            for k in range(2):  # a step is the first half of one window and the second of another
                half = _WEIGHT[k * STRIDE : (k + 1) * STRIDE].astype(np.float32)
                self.total[:, own + k] += scores[:, :, k * STRIDE : (k + 1) * STRIDE] * half
                self.weight[own + k] += half
        self.run[windows] = True
        self.known[steps] = True

    def stretches(self, wanted: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches of open texts between places where every best path has O, those with a place that `wanted`
        flags: where in the scores they begin and end, and the scores, the places and the steps that they lack. A step
        whose scores are not known counts as one whose path may be inside any span."""
        known = self.known & open_[self.owner]
        shown = known.copy()
        shown[:-1] |= known[1:] & ~self.first[1:]
        shown[1:] |= known[:-1] & ~self.first[1:]
        steps = np.flatnonzero(shown)
        scores = self.total[:, steps] / np.maximum(self.weight[steps], np.float32(1e-6))
        dark = ~self.known[steps]
        scores[:, dark] = 0
        scores[2::2, dark] = _UNKNOWN
        scores = scores.reshape(len(scores), -1)
        places = (steps[:, None] * STRIDE + np.arange(STRIDE)).reshape(-1)
        inside = places - np.repeat(self.bounds[self.owner[steps]], STRIDE) * STRIDE
        own = np.repeat(self.lengths[self.owner[steps]], STRIDE)
        free = ~self.tagger.outside(scores, inside == own - 1) & (inside < own)
        cut = np.zeros(len(free), bool)  # where another text, or another part of the same, begins
        cut[::STRIDE] = self.first[steps] | (np.diff(steps, prepend=-2) != 1)
        begin = np.flatnonzero(free & (cut | ~np.concatenate([[False], free[:-1]])))
        end = np.flatnonzero(free & np.append(cut[1:] | ~free[1:], True)) + 1
        held = np.concatenate([[0], np.cumsum(wanted[places])])
        hot = held[end] > held[begin]
        begin, end = begin[hot], end[hot]
        lacks = [s for b, e in zip(begin // STRIDE, -(-end // STRIDE), strict=True) for s in range(b, e) if dark[s]]
        return begin, end, scores, places, np.unique(steps[lacks])


#: A score for labels inside spans that no network gives.
_UNKNOWN = np.float32(1e6)


def tagged_spans(texts: list[str], tagger: Tagger, block: int = 1024, places: list[list[int]] | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) by the network for each text, as far as spans hold one of the text's `places` (without them: a
    digit or an at); of other spans some come too.

    The paths are those of all windows of the text: scores are worked out around the places, and further on until places
    where every best path has O bound what has to be decoded.
    """
    if places is None:
        places = [[m.start() for m in _NEEDED.finditer(t)] for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    filled = [k for k, own in enumerate(places) if own]
    at, owners, parts, waiting = 0, [], [], 0
    while at < len(filled):  # as many texts at once as fill a block, a longer one alone
        some, size, wanted = [], 0, 0
        while at < len(filled):
            size += len(texts[filled[at]])
            wanted += len({p // STRIDE for p in places[filled[at]]})
            if some and (wanted > block or size > TOGETHER):
                break
            some.append(filled[at])
            at += 1
        known = _Scores([texts[k] for k in some], tagger, block)
        flags = np.zeros(known.bounds[-1] * STRIDE, bool)
        for k, low in zip(some, (known.bounds * STRIDE).tolist(), strict=False):
            flags[np.array(places[k]) + low] = True
        lacking = np.flatnonzero(flags.reshape(-1, STRIDE).any(1))
        open_ = np.ones(len(some), bool)
        while len(lacking):
            known.learn(lacking)
            begin, end, scores, where, lacking = known.stretches(flags, open_)
            open_[:] = False
            open_[known.owner[lacking]] = True
            own = known.owner[where[begin] // STRIDE]
            done = (end - begin >= _LEAST) & ~open_[own]
            for b, e, text in zip(begin[done].tolist(), end[done].tolist(), own[done].tolist(), strict=True):
                k, s = some[text], int(where[b] - known.bounds[text] * STRIDE)
                owners.append((k, s))
                parts.append((scores[:, b:e].T.copy(), -1 if s == 0 else 0, None if s + e - b == len(texts[k]) else 0))
                waiting += e - b
        if at == len(filled) or waiting > 400_000:
            for (k, s), path in zip(owners, tagger.decode_parts(parts), strict=True):
                found[k] += _spans_of(path, s)
            owners, parts, waiting = [], [], 0
    return found


def _spans_of(path: list[int], start: int) -> Iterator[tuple[int, int, int]]:
    at = 0
    while at < len(path):
        e = at + 1
        if path[at]:
            kind = (path[at] - 1) // 2
            while e < len(path) and path[e] == 2 + 2 * kind:
                e += 1
            yield start + at, kind, start + e
        at = e


def _substance(kind: int, span: str) -> bool:
    """Whether the span has what its kind can't be without."""
    digits = _digits(span)
    if kind == 0:
        at = _AT.search(span)
        return bool(at and span[: at.start()].strip(" ([{<") and (dot := _DOT.search(span, at.end())) and span[dot.end() :].strip(" )]}>") and len(span.split()) <= 9)
    if kind == 1:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", span)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", span)
    return 7 <= len(digits) <= 15 and len(digits) >= 0.5 * len(span) and not re.search(r"[A-Za-z]", span)


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """The span without white space and marks at its ends; a bracket stays where its partner is inside."""
    while s < e and (text[s] in " \n\t" or text[s] == "(" and ")" not in text[s:e]):
        s += 1
    while s < e and (text[e - 1] in " \n\t.,;:!?" or text[e - 1] == ")" and "(" not in text[s:e]):
        e -= 1
    return s, e


def _places(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """Places of which every span that can be added holds one: outside base spans, an at, or, for the kinds without
    letters, digits of a stretch without letters that has four numbers or seven digits; four digits in turn stand for
    each other, as such a span has four or more."""
    ats, out, done = [m.start() for m in _AT.finditer(text)], [], 0
    for s, _, e in [*base, (len(text), 0, len(text))]:
        if done < s:
            out += ats[bisect_left(ats, done) : bisect_left(ats, s)]
            for m in _NUMBERS.finditer(text, done, s):
                digits = [x.start() for x in _DIGIT.finditer(text, *m.span())]
                if len(digits) >= 7 or len(digits) >= 4 and sum(b > a + 1 for a, b in pairwise(digits)) >= 3:
                    out += digits[3::4]
        done = max(done, e)
    return out


def spans_of_texts(texts: list[str], tagger: Tagger) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, base spans and those the network adds) of each text."""
    bases = [base_spans(text) for text in texts]
    places = [_places(text, base) for text, base in zip(texts, bases, strict=True)]
    for text, base, tagged in zip(texts, bases, tagged_spans(texts, tagger, places=places), strict=True):
        added: list[tuple[int, int, int]] = []
        for s, k, e in tagged:
            s, e = _trimmed(text, s, e)
            if s < e and _substance(k, text[s:e]) and all(e <= bs or s >= be for bs, _, be in [*base, *added]):
                added.append((s, k, e))
        yield base, sorted([*base, *added])


def all_spans(text: str, tagger: Tagger) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """`spans_of_texts` for one text."""
    return next(spans_of_texts([text], tagger))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, tagger: Tagger | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, base (kind:start:end, joined), spans (likewise) and the redacted text, for every row."""
    small_batches(docs.sparkSession)
    model = tagger or trained()
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, texts = [], [], []
            given = [text or "" for text in batch.column(1).to_pylist()]
            for text, (own, every) in zip(given, spans_of_texts(given, model), strict=True):
                base.append(joined(own))
                spans.append(joined(every))
                texts.append(redacted(text, every))
            yield pa.record_batch([batch.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(texts, pa.string())], names=["_id", "base", "spans", "redacted"])

    out = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(lean(run), f"_id {kind}, base string, spans string, redacted string")
    return out.withColumnRenamed("_id", id_column)


def cleaned(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The same rows and columns with every span of `text` replaced by its kind, and `n_chars` to match. A null text stays
    null, an empty one empty; repeated rows stay repeated."""
    small_batches(docs.sparkSession)
    model, at = tagger or trained(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at).to_pylist()
            found = spans_of_texts([t or "" for t in given], model)
            texts = [None if t is None else redacted(t, every) for t, (_, every) in zip(given, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", f"{kind}:")) - 1).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def sha256_of_base(text: str | None) -> str:
    """What op3 returns for one text, for tests."""
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
