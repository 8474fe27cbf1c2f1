import re

import duckdb

from seqloom.llm import licenses

TEXTS = [
    None, "", "No word of it.", "Released under the MIT License.", "First.\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "This is licensed under stars.",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nOther. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n",
    "x" * 200_000 + ". All rights reserved. " + "word " * 50_000, "ALL RIGHTS RESERVED!", "all\x01rights reserved. All rights reserved.", "SPDX-License-Identifier: MIT",
]


def test_equals_sql(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, TEXTS[4], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(str, licenses.scan(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW d AS SELECT 1")
    found = con.execute(licenses.oracle_sql())
    names = [c[0] for c in found.description]
    order = ["doc_id", "n_sentences", "n_known", "sentence_ids", "licences", "first_licence"]
    want = sorted("Row(" + ", ".join(f"{n}={dict(zip(names, r))[n]!r}" for n in order) + ")" for r in found.fetchall())
    assert got == want


def test_rules_name_the_licence(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert [found[k] for k in (0, 1, 2, 3, 5, 7)] == ["", "", "", "MIT", "", ""]
    assert found[4] == "CC-BY-NC-4.0,all-rights-reserved" and found[6] == "Apache-2.0" and found[8] == "BSD-2-Clause" and found[12] == "MIT"
    assert licenses.scan(df.limit(0)).collect() == []


def brute(text):
    """The documented rules character by character and by sequences of identifiers, without the operator's patterns."""
    text, cuts, i = text or "", [], 0
    own = ""
    while i < len(text):  # an end of sentence takes the white space behind it
        own += text[i]
        if text[i] in ".!?" and i + 1 < len(text) and text[i + 1] in " \t\r\n":
            while i + 1 < len(text) and text[i + 1] in " \t\r\n":
                i += 1
            cuts.append(own)
            own = ""
        i += 1
    cuts.append(own)
    out = []
    for part in (p for c in cuts for p in c.split("\x01")):
        for piece in re.split(r"\n[ \t\r]*(?=[A-Z\n])", part):
            words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in piece).split()
            if words:
                out.append(" ".join(words))
    known = dict(licenses.KNOWN)
    ids = [known.get(s, 0) for s in out]
    names = {name: k + 1 for k, name in enumerate([*licenses.SENTENCES, *(f"notice:{n}" for n in licenses.NAMES)])}

    def holds(rule, at):  # the rule's first identifier at this place, each next one after at most GAP others
        if len(rule) == 1:
            return True
        return any(ids[k : k + 1] == [rule[1]] and holds(rule[1:], k) for k in range(at + 1, at + 2 + licenses.GAP))

    matched = [licence for licence, rule in licenses.RULES if any(i == names[rule[0]] and holds([names[r] for r in rule], k) for k, i in enumerate(ids))]
    return len(out), sum(i > 0 for i in ids), ",".join(str(i) for i in ids if i), ",".join(sorted(set(matched))), (matched or [None])[0]


def test_equals_brute_force(spark):
    more = ["First one. Second one. Third one.", "This work is in the public\ndomain.", "This work is in the Public-Domain!", "\u212a. \u0130x?  No", "a.\n \tB\n\nC \r\n D", ". . .", "\x01\x01 a \x01", "Licensed under MIT.Then. Licensed under MIT."]
    texts = [*TEXTS[:9], *TEXTS[10:], *more]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.n_known, r.sentence_ids, r.licences, r.first_licence) for r in licenses.scan(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert got[len(texts) - len(more)][0] == 3 and got[len(texts) - len(more) + 1][3] == "public-domain"
