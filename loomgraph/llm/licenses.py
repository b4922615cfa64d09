"""License scans by sentence rules.

Sentences are normalised to lower-case letters, digits and single blanks, mapped to identifiers of known licence sentences,
and the identifier sequence of each document is matched against ordered rules. A rule matches where its identifiers follow
each other with no other *known* sentence between, and uses them up. A text is read twice: by lines (sentences end at line
ends and at stops before a blank, ``!`` and ``?``), and with wrapped lines joined (they end at copyright lines, lines without
letters, stops, ``!``, ``?``, ``;`` and ``:``). Rules of class ``reserved`` name a licence only where no other rule does:
most notices begin with a reservation of rights.

Only sentences of the tables below are known; a licence with other sentences is not found. Null and empty texts give no
sentences and no licence; repeated sentences count once per occurrence; very long texts are read whole; equal texts get equal
rows, and an empty table an empty result. Own columns named as the added ones are replaced.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, quoted, unboxed

# Identifier -> normalised sentence.
SENTENCES = {
    "mit.name": "released under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit.title": "mit license",
    "apache.name": "licensed under the apache license version 2 0",
    "apache.use": "you may not use this file except in compliance with the license",
    "gpl3.name": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software",
    "gpl.redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license",
    "ccbync4.name": "licensed under cc by nc 4 0",
    "ccby4.name": "licensed under cc by 4 0",
    "bsd.keep": "redistributions of source code must retain the above copyright notice",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice",
    "reserved": "all rights reserved",
}
_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_LISTED = "redistributions {} the above copyright notice this list of conditions and the following disclaimer"
_ISC = "permission to use copy modify and {}distribute this software for any purpose with or without fee is hereby granted"
_EPL = "this program and the accompanying materials are made available under the terms of the eclipse public license {} at {}"
_CC = "this work is licensed under {} creative commons attribution {}4 0 international license"
# Identifiers that may stand behind "SPDX-License-Identifier", with their classes.
SPDX = {
    "0BSD": "permissive", "AGPL-3.0-only": "copyleft", "AGPL-3.0-or-later": "copyleft", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "BSL-1.0": "permissive",
    "CC-BY-4.0": "permissive", "CC-BY-NC-4.0": "noncommercial", "CC-BY-SA-4.0": "copyleft", "CC0-1.0": "permissive", "EPL-2.0": "copyleft", "GPL-2.0-only": "copyleft", "GPL-2.0-or-later": "copyleft",
    "GPL-3.0-only": "copyleft", "GPL-3.0-or-later": "copyleft", "ISC": "permissive", "LGPL-2.1-only": "copyleft", "LGPL-2.1-or-later": "copyleft", "LGPL-3.0-only": "copyleft", "LGPL-3.0-or-later": "copyleft",
    "MIT": "permissive", "MPL-2.0": "copyleft", "Unlicense": "permissive", "Zlib": "permissive",
}
# The GNU licences, (identifier, word in the title, versions of which a notice may take any later one).
GNU = [("gpl", "", ["2", "3"]), ("lgpl", "lesser ", ["2.1", "3"]), ("agpl", "affero ", ["3"])]
# The attribution licences, suffix -> (words in the title, class).
CC = {
    "": ("", "permissive"), "-SA": ("sharealike ", "copyleft"), "-NC": ("noncommercial ", "noncommercial"), "-NC-SA": ("noncommercial sharealike ", "noncommercial"),
    "-ND": ("noderivatives ", "noderivatives"), "-NC-ND": ("noncommercial noderivatives ", "noncommercial"),
}
# Identifier -> further normalised sentences, whole as in the unmodified notices.
VARIANTS = {
    "mit.grant": [
        SENTENCES["mit.grant"] + " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit.title": ["the mit license", "the mit license mit"],
    "apache.name": ["licensed under the apache license version 2 0 the license"],
    "apache.use": ["you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "lgpl.free": ["this library is free software"],
    "mpl2.name": ["this source code form is subject to the terms of the mozilla public license v"],
    "isc.grant": [_ISC.format(x) + " provided that the above copyright notice and this permission notice appear in all copies" for x in ("", "or ")],
    "0bsd.grant": [_ISC.format("or ")],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.keep": [_LISTED.format("of source code must retain")],
    "bsd.binary": [_LISTED.format("in binary form must reproduce") + " in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "unlicense.name": ["this is free and unencumbered software released into the public domain"],
    "zlib.grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost.name": ["distributed under the boost software license version 1 0"],
    "epl2.name": [_EPL.format(x, at) for x in ("2 0 which is available", "v2 0 which accompanies this distribution and is available") for at in ("http", "https")],
    "gpl.redistribute": [_GNU.format("")],
    "gnu2.only": ["version 2 of the license"],
    **{f"gnu{v}.later": [_LATER.format(v.replace(".", " "))] for v in ("2", "2.1", "3")},
    **{f"{g}.redistribute": [_GNU.format(word)] for g, word, _ in GNU if g != "gpl"},
    **{f"{g}{v}.redistribute": [_GNU.format(word) + " " + _LATER.format(v.replace(".", " "))] for g, word, versions in GNU for v in versions},
    **{f"cc.by{k}": [_CC.format(a, words) for a in ("a", "the")] for k, (words, _) in CC.items()},
    **{f"spdx.{x}": ["spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")] for x in SPDX},
}


def _gnu_rules():
    """Per GNU licence: the version inside the sentence, behind a semicolon, or not told."""
    for g, _, versions in GNU:
        for free in ("gpl.free", "lgpl.free"):
            for v in versions:
                name = f"{g.upper()}-{v if '.' in v else v + '.0'}-or-later"
                yield name, "copyleft", [free, f"{g}{v}.redistribute"]
                yield name, "copyleft", [free, f"{g}.redistribute", f"gnu{v}.later"]
            if g == "gpl":
                yield "GPL-2.0-only", "copyleft", [free, "gpl.redistribute", "gnu2.only"]
            yield g.upper(), "copyleft", [free, f"{g}.redistribute"]


def _bsd_rules():
    for endorse, name in ((["bsd.endorse"], "BSD-3-Clause"), ([], "BSD")):
        for before in (["reserved", "bsd.grant"], ["reserved"], ["bsd.grant"], []):
            yield name, "permissive", [*before, "bsd.keep", "bsd.binary", *endorse]


# Ordered rules, longer ones of a licence first; (licence, class, identifier sequence).
RULES = sorted([*_gnu_rules(), *_bsd_rules()], key=lambda rule: -len(rule[2])) + [
    ("MIT", "permissive", ["mit.title", "mit.grant"]),
    ("Apache-2.0", "permissive", ["apache.name", "apache.use"]),
    ("MIT", "permissive", ["mit.grant"]),
    ("ISC", "permissive", ["isc.grant"]),
    ("0BSD", "permissive", ["0bsd.grant"]),
    ("MPL-2.0", "copyleft", ["mpl2.name"]),
    ("EPL-2.0", "copyleft", ["epl2.name"]),
    ("Unlicense", "permissive", ["unlicense.name"]),
    ("Zlib", "permissive", ["zlib.grant"]),
    ("BSL-1.0", "permissive", ["boost.name"]),
    ("MIT", "permissive", ["mit.name"]),
    ("MIT", "permissive", ["mit.title"]),
    ("Apache-2.0", "permissive", ["apache.name"]),
    ("GPL-3.0", "copyleft", ["gpl3.name"]),
    ("CC-BY-NC-4.0", "noncommercial", ["ccbync4.name"]),
    ("CC-BY-4.0", "permissive", ["ccby4.name"]),
    *((f"CC-BY{k}-4.0", kind, [f"cc.by{k}"]) for k, (_, kind) in CC.items()),
    *((x, kind, [f"spdx.{x}"]) for x, kind in SPDX.items()),
    ("proprietary", "reserved", ["reserved"]),
]
#: A stop before no blank (version numbers) does not end a sentence.
SPLIT = r"\n|[!?]+|\.+(?=\s|$)"
#: Wrapped notices: lines are joined, and sentences end at copyright lines, lines without letters, stops, ``;`` and ``:``.
COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|©).*$"
WRAPPED = r"\n[^\p{L}\p{N}\n]*(?=\n)|[!?;:]+|\.+(?=\s|$)"


def scan(docs: DataFrame, text: str = "text", sentences=None, rules=None) -> DataFrame:
    """Add ``n_sentences`` (long), ``sentence_ids`` (array, known sentences in order) and ``licenses`` (sorted array)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    pairs = [*sentences.items(), *((k, v) for k, more in (VARIANTS if sentences is SENTENCES else {}).items() for v in more)]
    known = F.create_map(*[F.lit(x) for k, v in pairs for x in (v, k)])
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))

    def split(value, pattern):
        clean = F.transform(F.split(value, pattern), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
        return F.filter(clean, lambda s: s != "")

    # A set finds the few known sentences; the map, which is searched from its start, is asked for those alone.
    named = lambda parts: F.transform(F.filter(parts, lambda s: s.isin([v for _, v in pairs])), lambda s: F.try_element_at(known, s))
    out = docs.select(boxed(docs), split(whole, SPLIT).alias("_parts"), named(split(F.regexp_replace(whole, COPYRIGHT, "\n\n"), WRAPPED)).alias("_joined"))
    out = out.withColumn("_lines", named(F.col("_parts")))
    # A text is read by lines and with lines joined; the reading that knows more sentences gives their identifiers.
    ids = F.when(F.size("_joined") > F.size("_lines"), F.col("_joined")).otherwise(F.col("_lines"))
    chain = F.concat(*[F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" |")) for c in ("_lines", "_joined")])
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq"), F.lit(kind == "reserved").alias("last")) for name, kind, seq in rules])
    begin = F.struct(chain.alias("left"), F.array().cast("array<string>").alias("hits"))

    def match(state, rule):
        hit = F.when(F.contains(state["left"], rule["seq"]) & (~rule["last"] | (F.size(state["hits"]) == 0)), F.array(rule["name"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.replace(state["left"], rule["seq"], F.lit(" | ")).alias("left"), F.concat(state["hits"], hit).alias("hits"))

    found = F.when(F.size("_lines") + F.size("_joined") > 0, F.array_sort(F.array_distinct(F.aggregate(table, begin, match, lambda state: state["hits"]))))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return out.select(*unboxed(docs.columns, ("n_sentences", F.size("_parts").cast("long")), ("sentence_ids", ids), ("licenses", found)))
