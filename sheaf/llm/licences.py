"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case; runs of anything but a-z and 0-9 become one space) and
mapped to the identifier of a known licence sentence, also where a notice wraps it before a capital, numbers it as an
item of a list or has a colon or semicolon inside it; the sequence of identifiers is then matched against ordered
rules, longest rule first, leftmost and without overlap. Everything happens inside the row, so no shuffle is needed.

Defined cases: a null or empty text has no sentence and no licence; repeated notices count each time; a known sentence
outside any complete rule is counted in `n_known` only; other columns are ignored, null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence notices, normalised.
SENTENCES = {
    "A": "licensed under the apache license version 2 0",
    "B": "licensed under the apache license version 2 0 the license",
    "C": "you may not use this file except in compliance with the license",
    "D": "you may obtain a copy of the license at",
    "E": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "F": "see the license for the specific language governing permissions and limitations under the license",
    "G": "released under the mit license",
    "H": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "I": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "J": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "K": "this work is licensed under the gnu general public license version 3",
    "L": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "M": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "N": "see the gnu general public license for more details",
    "O": "licensed under cc by nc 4 0",
    "P": "licensed under cc by 4 0",
    "Q": "this work is licensed under a creative commons attribution 4 0 international license",
    "R": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "S": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "T": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "U": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "V": "all rights reserved",
    "a": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "b": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "c": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "d": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "e": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "f": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "g": "this is free and unencumbered software released into the public domain",
    "h": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "i": "licensed under cc by sa 4 0",
    "j": "distributed under the boost software license version 1 0",
}
#: Ordered rules: the sequence of sentence identifiers, and the licence it stands for.
RULES = {
    "RSTU": "BSD-3-Clause", "RST": "BSD-2-Clause", "BCDEF": "Apache-2.0", "BCDE": "Apache-2.0", "BC": "Apache-2.0",
    "HIJ": "MIT", "HI": "MIT", "LMN": "GPL-3.0-or-later", "LM": "GPL-3.0-or-later", "L": "GPL-3.0-or-later",
    "A": "Apache-2.0", "B": "Apache-2.0", "G": "MIT", "K": "GPL-3.0-only", "O": "CC-BY-NC-4.0", "P": "CC-BY-4.0",
    "Q": "CC-BY-4.0", "V": "all-rights-reserved", "a": "LGPL-2.1-or-later", "b": "AGPL-3.0-or-later", "cMN": "GPL-2.0-or-later", "cM": "GPL-2.0-or-later", "c": "GPL-2.0-or-later",
    "de": "MPL-2.0", "d": "MPL-2.0", "f": "ISC", "g": "Unlicense", "h": "CC0-1.0", "i": "CC-BY-SA-4.0", "j": "BSL-1.0",
}
#: What a licence lets a training corpus do.
VERDICTS = {"CC-BY-NC-4.0": "restricted", "all-rights-reserved": "restricted", "GPL-3.0-only": "copyleft", "GPL-3.0-or-later": "copyleft", "GPL-2.0-or-later": "copyleft", "LGPL-2.1-or-later": "copyleft", "AGPL-3.0-or-later": "copyleft", "MPL-2.0": "copyleft", "CC-BY-SA-4.0": "copyleft"}
#: Of several licences in one text the first of these that occurs decides.
ORDER = ("restricted", "copyleft", "permissive")

LEADER = r"(^|\n)[ \t]*(#+|//+|\*+|;+)[ \t]"
WRAP = r'([a-z,])\n[ \t]*([a-z"(])'
STOP = r"([.!?;:])[ \t\r]+"
#: Between two words of a known sentence: anything but words, the end of a sentence and an empty line. Standard notices
#: of the GPL put a colon or semicolon at the places of INNER.
GAP = r"(?=[^A-Za-z0-9])(?:(?![.!?;:]\s)[^A-Za-z0-9\n])*+(?:\n(?![ \t\r]*\n)[^A-Za-z0-9\n]*+)?"
INNER_GAP = r"(?=[^A-Za-z0-9])[^A-Za-z0-9\n]*+(?:\n(?![ \t\r]*\n)[^A-Za-z0-9\n]*+)?"
INNER = ("free software|you can", "any warranty|without even", "software foundation|either", "license v|2 0")
ITEM = r"(?:(?<![^\n])[ \t]*\(?[0-9a-z]{1,2}[.)][ \t]+)?"


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pattern(sentence: str) -> str:
    """The sentence as notices have it: any case, broken over lines, with or without the number of a list item."""
    for place in INNER:
        sentence = sentence.replace(place.replace("|", " "), place)
    parts = [GAP.join(part.split()) for part in sentence.split("|")]
    return f"(?i){ITEM}(?<![A-Za-z0-9])(?:" + INNER_GAP.join(parts) + ")(?![A-Za-z0-9])"


def _notices_joined(flat: Column) -> Column:
    """The text with each known sentence in one piece; whatever stands around a sentence stays."""
    starts = "|".join(dict.fromkeys(GAP.join(s.split()[:3]) for s in SENTENCES.values()))
    joined = flat
    for sentence in sorted(SENTENCES.values(), key=len, reverse=True):
        joined = F.regexp_replace(joined, _pattern(sentence), sentence)
    return F.when(flat.rlike(f"(?i)(?:{starts})"), joined).otherwise(flat)


def sentence_ids(text: Column) -> Column:
    """One character a sentence: its identifier, or '.' for an unknown sentence; empty sentences are left out."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), LEADER, "$1")
    flat = F.regexp_replace(_notices_joined(F.regexp_replace(flat, WRAP, "$1 $2")), STOP, "$1\n")
    known, marks = _literals(SENTENCES.values()), _literals(SENTENCES)

    def mark(sentence: Column) -> Column:
        normal = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
        return F.coalesce(F.get(marks, F.array_position(known, normal).cast("int") - 1), F.lit("."))

    return F.array_join(F.transform(F.filter(F.split(flat, "\n"), lambda s: s.rlike("[A-Za-z0-9]")), mark), "")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, sentence_ids, licences (array, in order), n_sentences, n_known, verdict."""
    rows = docs.select(F.col(id_column), sentence_ids(F.col(text_column)).alias("sentence_ids"))
    longest_first = sorted(RULES, key=lambda r: -len(r))
    names = _literals(RULES[r] for r in longest_first)
    found = F.regexp_extract_all("sentence_ids", F.lit("(" + "|".join(longest_first) + ")"), 1)
    rows = rows.withColumn("licences", F.transform(found, lambda m: F.get(names, F.array_position(_literals(longest_first), m).cast("int") - 1)))
    kinds = _literals(VERDICTS.get(RULES[r], "permissive") for r in longest_first)
    rows = rows.withColumn("_kinds", F.transform("licences", lambda n: F.get(kinds, F.array_position(names, n).cast("int") - 1)))
    verdict = F.lit("none")
    for kind in reversed(ORDER):
        verdict = F.when(F.array_contains("_kinds", kind), F.lit(kind)).otherwise(verdict)
    return rows.select(
        id_column, "sentence_ids", "licences", F.length("sentence_ids").cast("long").alias("n_sentences"),
        F.length(F.regexp_replace("sentence_ids", "[.]", "")).cast("long").alias("n_known"), verdict.alias("verdict"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with its licences joined by commas, in order."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_sentences", "n_known", "verdict")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    longest_first = sorted(RULES, key=lambda r: -len(r))
    marks = "MAP {" + ", ".join(f"{quote(v)}: {quote(k)}" for k, v in SENTENCES.items()) + "}"
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in RULES.items()) + "}"
    verdict = "CASE " + " ".join(
        f"WHEN len(list_filter(ls, lambda l: l IN ({', '.join(quote(n) for n in dict.fromkeys(RULES.values()) if VERDICTS.get(n, 'permissive') == kind)}))) > 0 THEN '{kind}'" for kind in ORDER
    ) + " ELSE 'none' END"
    return f"""
WITH flat AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{LEADER}', '\\1', 'g'), '{WRAP}', '\\1 \\2', 'g'), '{STOP}', '\\1' || chr(10), 'g') AS t FROM documents),
seq AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[A-Za-z0-9]')),
  lambda s: coalesce(({marks})[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))], '.')), '') AS ids FROM flat),
found AS (SELECT doc_id, ids, list_transform(regexp_extract_all(ids, '{"|".join(longest_first)}'), lambda m: ({names})[m]) AS ls FROM seq)
SELECT doc_id, coalesce(array_to_string(ls, ','), '') AS licences, length(ids)::BIGINT AS n_sentences, length(replace(ids, '.', ''))::BIGINT AS n_known, {verdict} AS verdict FROM found"""


ORACLE = _sql()
