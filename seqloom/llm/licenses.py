"""Licence scan by sentence rules, in DataFrame operations only.

Every text is cut into sentences, each is normalised to lower-case words, and known
licence sentences become identifiers; the identifiers in text order are matched
against ordered rules.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_or_empty

# Names under which short notices mention a licence.
NAMES = {
    "MIT": ["the mit license", "mit license", "the mit licence", "mit"],
    "Apache-2.0": ["the apache license version 2 0", "apache license version 2 0", "apache license 2 0", "the apache license 2 0", "apache 2 0"],
    "BSD-2-Clause": ["the bsd 2 clause license", "bsd 2 clause license", "the simplified bsd license"],
    "BSD-3-Clause": ["the bsd 3 clause license", "bsd 3 clause license", "the new bsd license", "the modified bsd license"],
    "ISC": ["the isc license", "isc license"],
    "GPL-2.0": ["the gnu general public license version 2", "the gnu gpl version 2", "gpl v2", "the gpl v2", "gplv2"],
    "GPL-3.0": ["the gnu general public license version 3", "the gnu gpl version 3", "gpl v3", "the gpl v3", "gplv3"],
    "LGPL-2.1": ["the gnu lesser general public license version 2 1", "lgpl v2 1"],
    "LGPL-3.0": ["the gnu lesser general public license version 3", "lgpl v3"],
    "AGPL-3.0": ["the gnu affero general public license version 3", "agpl v3"],
    "MPL-2.0": ["the mozilla public license version 2 0", "the mozilla public license 2 0", "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "the creative commons cc0 1 0 universal license"],
    "CC-BY-4.0": ["cc by 4 0", "the creative commons attribution 4 0 international license", "a creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "the creative commons attribution sharealike 4 0 international license", "a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "the creative commons attribution noncommercial 4 0 international license", "a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0"],
}
# How short notices begin.
OPENINGS = [
    "licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this software is licensed under", "this project is licensed under",
    "this file is licensed under", "this software is released under", "this work is released under", "this code is licensed under", "this content is licensed under", "this document is licensed under",
    "this article is licensed under", "this text is licensed under", "dual licensed under", "licensed under the terms of", "released under the terms of",
]
# Sentences of licence texts and notices, normalised, by a name of their own.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-grant-alone": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-short": "licensed under the apache license version 2 0 the license",
    "apache-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd-forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "domain": "this work is in the public domain",
    "reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl2": "spdx license identifier gpl 2 0 only",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}
# The licence that a sequence of sentences states, the first rule that fits naming it; up to GAP other sentences may stand between.
RULES = [
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-grant-alone", "mit-notice"]),
    ("Apache-2.0", ["apache-use"]),
    ("Apache-2.0", ["apache-short", "apache-not"]),
    ("Apache-2.0", ["apache-not", "apache-copy"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-forms", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl-form"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-2.0", ["spdx-gpl2"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    *((licence, [f"notice:{licence}"]) for licence in NAMES),
    ("public-domain", ["domain"]),
    ("all-rights-reserved", ["reserved"]),
]
GAP = 2
#: Every known sentence has a word that holds one of these; checked for the tables when the module loads.
STEMS = ["licens", "licenc", "released", "distributed", "available", "published", "reserved", "permission", "redistribut", "software", "public", "copyright"]


def known_sentences() -> list[tuple[str, int]]:
    """(normalised sentence, identifier from 1); different wordings of one notice share an identifier."""
    names = list(SENTENCES) + [f"notice:{licence}" for licence in NAMES]
    ids = {name: k + 1 for k, name in enumerate(names)}
    found = [(text, ids[name]) for name, text in SENTENCES.items()]
    found += [(f"{opening} {name}", ids[f"notice:{licence}"]) for licence, own in NAMES.items() for opening, name in product(OPENINGS, own)]
    return found


KNOWN = known_sentences()
assert all(any(a in text for a in STEMS) for text, _ in KNOWN) and not any(" " in a for a in STEMS)
assert len({text for text, _ in KNOWN}) == len(KNOWN)


def rule_patterns() -> list[tuple[str, str]]:
    """(licence, pattern over a text's comma-joined identifiers, 0 for other sentences)."""
    names = list(SENTENCES) + [f"notice:{licence}" for licence in NAMES]
    ids = {name: k + 1 for k, name in enumerate(names)}
    return [(licence, "," + f",([0-9]+,){{0,{GAP}}}".join(str(ids[s]) for s in own) + ",") for licence, own in RULES]


def pieces(text: Column) -> Column:
    """Sentences as they stand, with empty ones. They end at . ! or ? before white space, at a blank line, and before a line that starts with A-Z."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\x01")
    return F.split(F.regexp_replace(marked, r"\n[ \t\r]*([A-Z\n])", "\x01$1"), "\x01", -1)


def normalised(piece: Column) -> Column:
    """Lower-case words with one space between; what the first step leaves is ASCII, so lower() changes A-Z alone."""
    return F.trim(F.lower(F.regexp_replace(piece, "[^A-Za-z0-9]+", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, sentence_ids, licences, first_licence.

    n_sentences counts the non-empty sentences of every text, n_known those that
    are licence sentences. sentence_ids are the identifiers in order,
    comma-joined, without the other sentences. licences are the names whose rules
    match, sorted and comma-joined; first_licence is that of the first rule that
    matches, null if none does. Null and empty texts have no sentences; repeated
    rows are scanned each; empty tables give no rows.
    """
    known = F.create_map(*(F.lit(x) for pair in KNOWN for x in pair))
    wordings = [text for text, _ in KNOWN]
    text = text_or_empty()
    # A word stands in the text as it does in the sentence but for case, so without any of STEMS no sentence is known.
    may = F.exists(F.transform(F.array(F.lower(text)), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(a)) for a in STEMS))), lambda found: found)
    cut = docs.select("doc_id", may.alias("may"), F.filter(pieces(text), lambda s: s.rlike("[A-Za-z0-9]")).alias("cut"))
    # Membership is a hash lookup; only a known sentence is searched for in the map.
    coded = F.transform(F.transform("cut", normalised), lambda s: F.when(s.isin(wordings), F.try_element_at(known, s)).otherwise(F.lit(0)))
    coded = cut.select("doc_id", F.size("cut").cast("bigint").alias("n_sentences"), F.when(F.col("may"), coded).otherwise(F.array().cast("array<int>")).alias("ids"))
    line = F.when(F.exists("ids", lambda i: i > 0), F.concat(F.lit(","), F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit(","))).otherwise("")
    coded = coded.select("doc_id", "n_sentences", "ids", line.alias("line"))
    matched = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(licence)) for licence, p in rule_patterns())))
    return coded.select("doc_id", "n_sentences", "ids", F.when(F.col("line") != "", matched).otherwise(F.array().cast("array<string>")).alias("matched")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_sentences",
        F.size(F.filter("ids", lambda i: i > 0)).cast("bigint").alias("n_known"),
        F.array_join(F.transform(F.filter("ids", lambda i: i > 0), lambda i: i.cast("string")), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("matched")), ",").alias("licences"),
        F.try_element_at("matched", F.lit(1)).alias("first_licence"),
    )


def oracle_sql() -> str:
    """The same scan for DuckDB."""
    known = ", ".join(f"('{t}', {i})" for t, i in KNOWN)
    cases = ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{licence}' END" for licence, p in rule_patterns())
    abc = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
marked AS (SELECT r, regexp_replace(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\r]*([A-Z\\n])', chr(1) || '\\1', 'g') AS text FROM rows),
cut AS (SELECT r, unnest(string_split(translate(text, {abc}), chr(1))) AS raw, generate_subscripts(string_split(translate(text, {abc}), chr(1)), 1) AS pos FROM marked),
named AS (SELECT r, pos, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM cut),
coded AS (SELECT r, count(*) AS n, list(coalesce(id, 0) ORDER BY pos) AS ids FROM named LEFT JOIN known USING (sentence) WHERE sentence <> '' GROUP BY r),
lined AS (SELECT rows.r, doc_id, coalesce(n, 0) AS n, list_filter(coalesce(ids, []), lambda x: x > 0) AS own,
                 CASE WHEN len(list_filter(coalesce(ids, []), lambda x: x > 0)) > 0 THEN ',' || array_to_string(ids, ',') || ',' ELSE '' END AS line FROM rows LEFT JOIN coded USING (r)),
matched AS (SELECT doc_id, n, own, list_filter([{cases}], lambda x: x IS NOT NULL) AS m FROM lined)
SELECT doc_id, n AS n_sentences, len(own) AS n_known, array_to_string(own, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(m)), ',') AS licences, m[1] AS first_licence FROM matched
"""
