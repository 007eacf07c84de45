"""Licence scans by sentences, in DataFrame functions only.

A text is normalised to lower-case ASCII words, so that line wraps, comment marks, bullets, quotes and brackets don't matter. Where a sentence
of the catalogue stands in it, it is cut there and the sentence becomes its identifier; what stands between is a gap, unless it is a list
number or one of a few words that belong to no sentence. The identifier sequence is then matched against ordered rules: a rule is a sequence
of identifiers without gaps, and what a rule matches is taken out before the next rule looks. Only texts that hold one of the catalogue's
anchors are cut up; each sentence has an anchor, so no other text can match. There is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which licences are granted, in normal form, and their identifiers; those of families are made below.
NAMES = {
    "mit license": "MIT",
    "mit": "MIT",
    "expat license": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache license v2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "bsd 3 clause license": "BSD-3-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "3 clause bsd license": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 2 clause": "BSD-2-Clause",
    "2 clause bsd license": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "isc license": "ISC",
    "isc": "ISC",
    "zlib license": "Zlib",
    "zlib": "Zlib",
    "unlicense": "Unlicense",
    "boost software license version 1 0": "BSL-1.0",
    "boost software license 1 0": "BSL-1.0",
    "bsl 1 0": "BSL-1.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "mpl 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "epl 2 0": "EPL-2.0",
    "cc0 1 0 universal": "CC0-1.0",
    "cc0 1 0": "CC0-1.0",
}
# Families of licences: words of the GNU licences with their versions, and parts of the Creative Commons ones.
GNU = {"GPL": ("", ["2", "3"]), "LGPL": ("lesser ", ["2.1", "3"]), "AGPL": ("affero ", ["3"])}
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = ["3.0", "4.0"]
# Words of a grant before "under" and the name.
GRANTS = ["licensed", "released", "distributed", "available", "provided", "published"]
# Sentences of licence texts in normal form.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-head": "apache license version 2 0 january 2004",
    "gnu-hope": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl-head": "mozilla public license version 2 0 1 definitions",
    "zlib-as-is": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}
# Licence texts as sequences of sentences; the longer ones of a family come first.
TEXTS = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source"]),
    ("Apache-2.0", ["grant Apache-2.0", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["grant Apache-2.0", "apache-use"]),
    ("Apache-2.0", ["apache-head"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", ["mpl-form"]),
    ("MPL-2.0", ["mpl-head"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["zero-grant", "isc-as-is"]),
    ("0BSD", ["zero-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["public-domain"]),
]
#: Holds only where no other rule does.
LAST = ("Proprietary", ["rights"])
ANCHORS = ["licen", "permi", "redistribut", "without any warranty", "as is", "public domain", "rights reserved", "advertising materials", "mpl was", "creativecommons", *[f"{g} under" for g in GRANTS]]
# Parts of sentences that differ from text to text, as patterns over the normal form, and what they become.
VARIANTS = [
    ("neither the names? (?:of )?(?:[a-z0-9]+ ){1,20}?nor the names of (?:its |any )?contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("this software is provided by (?:[a-z0-9]+ ){1,20}?as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("the software is provided as is and (?:[a-z0-9]+ ){1,8}?disclaims? all warranties", "the software is provided as is and the author disclaims all warranties"),
    ("merchantability fitness for a particular purpose and non infringement", "merchantability fitness for a particular purpose and noninfringement"),
]
#: What may stand between two sentences without being a gap: list numbers, the subject of a notice, the licence's short name, its address.
BETWEEN = "(?:(?:[0-9]{1,2}|[a-z]|and|the license|this (?:program|library|software|file|work|package)|https? www apache org licenses license 2 0(?: txt)?) )*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def names() -> dict[str, str]:
    """Name in normal form to licence, families included."""
    out = dict(NAMES)
    for short, (word, versions) in GNU.items():
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}"
            for form in {normal(v), normal(v if "." in v else v + ".0")}:
                for name in (f"gnu {word}general public license version {form}", f"gnu {word}general public license v{form}", f"gnu {word}general public license {form}", f"gnu {short.lower()} version {form}", f"gnu {short.lower()} v{form}", f"{short.lower()} version {form}", f"{short.lower()} {form}", f"{short.lower()}v{form}", f"{short.lower()} v{form}"):
                    out |= {name: licence, f"{name} or later": f"{licence}-or-later", f"{name} or any later version": f"{licence}-or-later", f"{name} only": f"{licence}-only"}
    for part, words in COMMONS.items():
        for v in COMMONS_VERSIONS:
            for name in (f"cc {normal(part)} {normal(v)}", f"creative commons {words} {normal(v)} international", f"creative commons {words} {normal(v)} international license", f"creative commons {words} {normal(v)} license", f"creative commons {words} {normal(v)}"):
                out[name] = f"CC-{part}-{v}"
    return out


def catalogue() -> dict[str, str]:
    """Sentence in normal form to identifier: the fixed sentences, notices and heads of the GNU licences, addresses of the Creative Commons ones."""
    out = {text: key for key, text in SENTENCES.items()}
    for short, (word, versions) in GNU.items():
        title = f"gnu {word}general public license"
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}"
            free = "is free software you can redistribute it and or modify it under the terms of the"
            out[f"{free} {title} as published by the free software foundation either version {normal(v)} of the license or at your option any later version"] = f"notice {licence}-or-later"
            out[f"{free} {title} as published by the free software foundation version {normal(v)} of the license"] = f"notice {licence}-only"
            out[f"{free} {title} version {normal(v)} as published by the free software foundation"] = f"notice {licence}-only"
            for day in ("june 1991", "february 1999", "29 june 2007", "19 november 2007"):
                out[f"{title} version {normal(v)} {day}"] = f"head {licence}"
    for part in COMMONS:
        for v in COMMONS_VERSIONS:
            out[f"creativecommons org licenses {normal(part)} {normal(v)}"] = f"grant CC-{part}-{v}"
    out["creativecommons org publicdomain zero 1 0"] = "grant CC0-1.0"
    return out


def _either(texts) -> str:
    """Alternatives, the longer ones first."""
    return "(?:" + "|".join(sorted(texts, key=lambda x: (-len(x), x))) + ")"


GRANT = f"(?:this work is |this project is |this software is |this file is )?(?:{'|'.join(GRANTS)}) under (?:the terms of )?(?:the |a )?"
TAG, LABEL = "spdx license identifier ", "license "


def pattern() -> str:
    """All sentences: of the catalogue, grants of names, tags for machines with several names, and a label with a short name."""
    own = names()
    name = _either(own)
    short = _either([n for n in own if "license" not in n])
    parts = [_either(catalogue()), f"{TAG}{short}(?: (?:or|and) {short})*", f"{GRANT}{name}", f"{LABEL}{short}"]
    return rf"\b((?:{'|'.join(parts)}))\b"


def rules() -> list[tuple[str, str]]:
    """(licence, identifier sequence) in the order in which they are tried: texts, notices, heads, then single grants; the last one is LAST."""
    known = dict.fromkeys(names().values())
    notices = [(key.split(" ", 1)[1], [key]) for key in dict.fromkeys(catalogue().values()) if key.startswith(("notice ", "head "))]
    grants = [(x, [f"grant {x}"]) for x in known]
    return [(licence, "".join(f"|{k}" for k in keys) + "|") for licence, keys in [*TEXTS, *notices, *grants, LAST]]


def _map(entries: dict[str, str]) -> Column:
    """A constant map; element_at looks a key up in it."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*[F.lit(v) for v in entries.values()]))


def _sequence(text: Column) -> Column:
    """The text's identifiers between bars, gaps as -, in order."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), F.lit(" "))
    for shape, becomes in VARIANTS:
        words = F.regexp_replace(words, shape, becomes)
    pieces = F.split(F.regexp_replace(words, pattern(), f"{MARK}$1{MARK}"), MARK)
    known, named = _map(catalogue()), _map(names())

    def identifiers(piece: Column) -> Column:
        tag = F.transform(F.split(F.replace(F.replace(F.substring(piece, len(TAG) + 1, 1 << 20), F.lit(" or later"), F.lit(" orlater")), F.lit(" or any"), F.lit(" orany")), " (?:or|and) "), lambda x: F.concat(F.lit("grant "), F.element_at(named, F.replace(F.replace(x, F.lit(" orlater"), F.lit(" or later")), F.lit(" orany"), F.lit(" or any")))))
        name = F.element_at(named, F.regexp_replace(piece, f"^(?:{GRANT}|{LABEL})", ""))
        return (
            F.when(F.element_at(known, piece).isNotNull(), F.array(F.element_at(known, piece))).when(piece.startswith(TAG), tag).when(name.isNotNull(), F.array(F.concat(F.lit("grant "), name)))
            .when(F.ltrim(piece).rlike(f"^{BETWEEN}$"), F.array().cast("array<string>")).otherwise(F.array(F.lit("-")))
        )

    return F.regexp_replace(F.concat(F.lit("|"), F.array_join(F.flatten(F.transform(pieces, identifiers)), "|"), F.lit("|")), "(\\|-)+\\|", "|-|")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentences, licenses, n_licenses) of each row of docs; other columns are ignored.

    sentences are the known identifiers in order, comma-joined; licenses the licences of the rules that match, in rule order, each once. Reserved
    rights alone are proprietary; beside a licence they say nothing. Null and empty texts have neither. Repeated rows and null ids are kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    has_anchor = body.rlike("(?i)" + "|".join(a.replace(" ", "[^A-Za-z0-9]+") for a in ANCHORS))
    tried = rules()
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(keys).alias("keys")) for licence, keys in tried])
    start = F.struct(F.col("sequence").alias("left"), F.array().cast("array<string>").alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        left, keys = state["left"], rule["keys"]
        holds = F.contains(left, keys) & ((rule["licence"] != LAST[0]) | (F.size(state["hits"]) == 0))
        return F.struct(F.replace(left, keys, F.lit("|-|")).alias("left"), F.when(holds, F.array_append(state["hits"], rule["licence"])).otherwise(state["hits"]).alias("hits"))

    cut = docs.select(F.col(doc_id).alias("doc_id"), F.when(has_anchor, _sequence(body)).otherwise(F.lit("||")).alias("sequence"))
    matched = cut.select("doc_id", "sequence", F.when(F.length("sequence") > 3, F.array_distinct(F.aggregate(table, start, step)["hits"])).otherwise(F.array().cast("array<string>")).alias("hits"))
    known = F.array_join(F.filter(F.split("sequence", "\\|"), lambda s: (s != "") & (s != "-")), ",")
    return matched.select("doc_id", known.alias("sentences"), F.array_join("hits", ",").alias("licenses"), F.size("hits").cast("long").alias("n_licenses"))


def oracle() -> str:
    """The same rows in DuckDB's SQL, over all texts without the anchor test."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda d: "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in d.items()) + "}"
    words = f"' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for shape, becomes in VARIANTS:
        words = f"regexp_replace({words}, {quote(shape)}, {quote(becomes)}, 'g')"
    tag = f"list_transform(regexp_split_to_array(replace(replace(substr(p, {len(TAG) + 1}), ' or later', ' orlater'), ' or any', ' orany'), ' (?:or|and) '), lambda x: 'grant ' || names[replace(replace(x, ' orlater', ' or later'), ' orany', ' or any')])"
    name = f"names[regexp_replace(p, {quote(f'^(?:{GRANT}|{LABEL})')}, '')]"
    each = f"CASE WHEN known[p] IS NOT NULL THEN [known[p]] WHEN starts_with(p, '{TAG}') THEN {tag} WHEN {name} IS NOT NULL THEN ['grant ' || {name}] WHEN regexp_full_match(ltrim(p), {quote(BETWEEN)}) THEN []::VARCHAR[] ELSE ['-'] END"
    steps = []
    for k, (licence, keys) in enumerate(rules()):
        alone = " AND len(hits) = 0" if licence == LAST[0] else ""
        steps.append(
            f"r{k + 1} AS (SELECT rid, doc_id, sequence, replace(remains, {quote(keys)}, '|-|') AS remains, "
            f"CASE WHEN contains(remains, {quote(keys)}) AND NOT list_contains(hits, {quote(licence)}){alone} THEN list_append(hits, {quote(licence)}) ELSE hits END AS hits FROM r{k})"
        )
    return f"""
WITH tables AS (SELECT {pairs(catalogue())} AS known, {pairs(names())} AS names),
pieces AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace({words}, {quote(pattern())}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
found AS (SELECT rid, doc_id, flatten(list_transform(parts, lambda p: {each})) AS ids FROM pieces WHERE len(parts) > 1, tables),
r0 AS (SELECT rid, doc_id, regexp_replace('|' || array_to_string(ids, '|') || '|', '(\\|-)+\\|', '|-|', 'g') AS sequence, sequence AS remains, CAST([] AS VARCHAR[]) AS hits FROM found),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_filter(string_split(sequence, '|'), lambda x: x <> '' AND x <> '-'), ',') AS sentences,
  array_to_string(hits, ',') AS licenses, CAST(len(hits) AS BIGINT) AS n_licenses
FROM r{len(rules())}
UNION ALL SELECT doc_id, '', '', 0 FROM pieces WHERE len(parts) = 1
""".replace("FROM pieces WHERE len(parts) > 1, tables", "FROM pieces, tables WHERE len(parts) > 1")
