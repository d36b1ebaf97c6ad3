"""op10: licence notices by sentence rules, in DataFrame functions only.

Texts are cut into sentences (also at blank lines and links), each normalised (lower case, everything but letters, digits,
dots, plus and minus signs to single spaces).  Known licence sentences become identifiers; the identifiers
of a text, in order, are matched against ordered rules, longest first; a rule inside the
match of an earlier one says nothing new and is left out.  All in one row: no shuffle, so
copies and hot sources cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import pick

# Opening sentences of public licence notices, normalised and cut as the splitter cuts (also at
# ":" and ";"); G7 and G8 are G2 G3 and G5 G6 of notices without those signs.
SENTENCES = {
    "A1": "licensed under the apache license version 2.0",
    "A2": "licensed under the apache license version 2.0 the license",
    "A3": "you may not use this file except in compliance with the license",
    "A4": "you may obtain a copy of the license at",
    "A5": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "A6": "see the license for the specific language governing permissions and limitations under the license",
    "M1": "released under the mit license",
    "M2": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "M3": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "M4": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "G1": "this work is licensed under the gnu general public license version 3",
    "G2": "this program is free software",
    "G3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G5": "this program is distributed in the hope that it will be useful but without any warranty",
    "G6": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "G7": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G8": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "G4": "you should have received a copy of the gnu general public license along with this program",
    "C1": "licensed under cc by-nc 4.0",
    "C2": "licensed under cc by 4.0",
    "C3": "this work is licensed under a creative commons attribution 4.0 international license",
    "B1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "B2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "P1": "licensed under the mozilla public license version 2.0",
    "R1": "all rights reserved",
}
# Ordered rules: (name, licence, identifiers that must follow each other).
RULES = [
    ("apache-header", "Apache-2.0", "A2 A3 A4 A5 A6"), ("mit-text", "MIT", "M2 M3 M4"), ("gpl-header", "GPL-3.0-or-later", "G2 G3 G5 G6 G4"),
    ("gpl-header", "GPL-3.0-or-later", "G7 G8 G4"), ("bsd-text", "BSD", "B1 B2"), ("apache-usage", "Apache-2.0", "A1 A3"), ("apache-line", "Apache-2.0", "A1"),
    ("apache-terms", "Apache-2.0", "A2"), ("mit-line", "MIT", "M1"), ("mit-grant", "MIT", "M2"), ("gpl-line", "GPL-3.0", "G1"),
    ("gpl-terms", "GPL-3.0-or-later", "G3"), ("gpl-terms", "GPL-3.0-or-later", "G7"),
    ("cc-by-nc", "CC-BY-NC-4.0", "C1"), ("cc-by", "CC-BY-4.0", "C2"),
    ("cc-by-work", "CC-BY-4.0", "C3"), ("mpl-line", "MPL-2.0", "P1"), ("reserved", "Proprietary", "R1"),
]
# Every known sentence holds one of these; a text with none has no notice.
HINTS = ["licen", "free software", "copyright", "permission", "redistribut", "warranty", "reserved"]


def identifiers(text: Column) -> Column:
    """Array of the known sentences' identifiers in a text, in order.  Sentences end at a line
    break, or lines are joined first (wrapped notices), as a whole or up to blank lines (without
    a letter or digit: comment signs may stand there) and links: the reading with most of them
    counts, the first of equals."""
    ends = r"[.!?:;]+(\s|$)"
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])

    def read(marked: Column) -> Column:
        plain = F.transform(F.split(marked, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9.+-]+", " ")))
        return F.transform(F.filter(plain, lambda s: s.isin(*SENTENCES.values())), lambda s: F.element_at(known, s))

    low = F.lower(text)
    blocks = F.regexp_replace(F.regexp_replace(low, r"\n[^\p{L}\p{N}\n]*\n", ". "), r"https?://\S+", ". ")
    readings = [low, *[F.regexp_replace(t, r"\s+", " ") for t in (low, blocks)]]
    return F.reduce(F.array(*[read(F.regexp_replace(t, ends, "\n")) for t in readings]), F.array().cast("array<string>"),
                    lambda a, b: F.when(F.size(b) > F.size(a), b).otherwise(a))


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_sentences (known ones), sentence_ids (blank-separated), rules
    and licenses (comma-separated, in rule order; a rule inside a longer matched one is left out).

    Null and empty texts and texts without a notice have 0 and empty strings; repeated rows
    are scanned each; an empty table gives an empty result; extra columns are ignored."""
    d = pick(docs, doc_id="long", text="string")
    low = F.lower(F.coalesce("text", F.lit("")))
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | low.contains(h)
    none = F.array().cast("array<string>")
    d = d.select("doc_id", F.when(hint, identifiers(F.col("text"))).otherwise(none).alias("ids"))
    d = d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(" ", "ids").alias("sentence_ids"))
    seq = F.concat(F.lit(" "), "sentence_ids", F.lit(" "))
    held: list[tuple[str, str, str, Column]] = []
    for name, lic, ids in RULES:
        ok = seq.contains(f" {ids} ")
        for _, _, longer, match in held:
            if f" {ids} " in f" {longer} ":
                ok = ok & ~match
        held.append((name, lic, ids, ok))
    rules = F.concat_ws(",", *[F.when(ok, F.lit(n)) for n, _, _, ok in held])
    lics = F.concat_ws(",", F.array_distinct(F.filter(F.array(*[F.when(ok, F.lit(x)) for _, x, _, ok in held]),
                                                      lambda v: v.isNotNull())))
    return d.select("doc_id", "n_sentences", "sentence_ids", rules.alias("rules"), lics.alias("licenses"))
