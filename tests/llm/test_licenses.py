import math
from collections import Counter
from pathlib import Path

import pytest

from regdelta.llm import licenses as L

SCHEMA = "doc_id long, path string, text string, folder string, rule string"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
PROSE = "Nothing to see in this line of prose.\nAnd nothing here."


def plain_scan(rows):
    """Own licences and inheritance with dictionaries, from the definitions."""
    total, df = 0, Counter()
    for _, _, text in rows:
        for _, s in L.segments(text or ""):
            total += 1
            df.update(set(L.terms(s)))
    templates = (*L.TEMPLATES, *L.TITLES)
    vocabulary = sorted({w for _, t in templates for w in L.terms(t)})
    idf = {w: math.log((1 + total) / (1 + df[w])) + 1 for w in vocabulary}
    middle = sorted(idf.values())[len(vocabulary) // 2]

    def vector(s):
        return {w: n * idf.get(w, middle) for w, n in Counter(L.terms(s)).items()}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    telling = lambda w: w[0].isnumeric() or w in L.QUALIFIERS

    def nearest(s, templates):
        words, v = set(L.terms(s)), vector(s)
        fits = []
        for n, t in templates:
            own = set(L.terms(t))
            if v and {w for w in own if telling(w)} <= words and words & L.QUALIFIERS == own & L.QUALIFIERS:
                fits.append((cosine(v, vector(t)), n))
        return max(fits, default=(0, None))

    own, rules = [], {}
    for doc, path, text in rows:
        text = text or ""
        best, size, covered, found = (0, None), sum(len(s) for _, s in L.segments(text)), set(), set()
        for at, s in [*L.segments(text), *L.wrapped(text)]:
            got = nearest(s, templates) if len(s) < 10_000 else (0, None)
            if got[0] >= L.SIMILARITY - 1e-12:
                covered.update(range(at, at + len(s)))
                found.add(got[1])
                if got[0] > best[0] + 1e-12:
                    best = got
        if best[1] == "BSD-2-Clause" and "BSD-3-Clause" in found:
            best = (best[0], "BSD-3-Clause")
        head = text.lstrip().split("\n\n")[0]
        licensed = size if any(nearest(x, L.TITLES)[0] >= L.SIMILARITY for x in (head, head.split("\n")[0])) else len(covered)
        own.append(best[1])
        folder = tuple(p for p in (path or "").split("/")[:-1] if p)
        name = (path or "").split("/")[-1].lower()
        if best[1] and (2 * licensed >= size or name.split(".")[0] in ("license", "copying")):
            rules[folder] = min(rules.get(folder, (9, "", "")), (-best[0], path, best[1]))
    out = []
    for (doc, path, _), licence in zip(rows, own):
        folder = tuple(p for p in (path or "").split("/")[:-1] if p)
        rule = next((rules[folder[:k]] for k in range(len(folder), -1, -1) if folder[:k] in rules), None)
        out.append((doc, path, licence, licence or (rule and rule[2]), path if licence else (rule and rule[1]), not licence and rule is not None))
    return sorted(out, key=str)


ROWS = [
    (1, "a/LICENSE", f"{PROSE}\n{MIT}\n{PROSE}"),
    (2, "a/b/x.py", PROSE),
    (3, "a/b/c/y.py", f"# {APACHE}\n{PROSE}"),
    (4, "a/b/c/z.py", PROSE),
    (5, "a/d/COPYING", APACHE),
    (6, "a/d/e/f/g.py", None),
    (7, "other/h.py", ""),
    (8, None, "words"),
    (None, "a//d/i.py", "words"),
    (9, "a/d/j.py", "w " * 200_000 + f"\n{MIT}\n" + "w " * 200_000),
    (10, "deep/k.txt", "Licensed under CC BY-NC 4.0."),
    (11, "deep/l.txt", "the licence of the house of the king is under the sea"),
    (2, "a/b/x.py", PROSE),
    (12, "gpl/main.c", "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n */\nint main() {}\n" + PROSE * 9),
    (13, "gpl/other.c", PROSE),
    (14, "isc/readme", "ISC License\n\nCopyright (c) 2020 Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED AS IT IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES."),
    (15, "isc/x.c", PROSE),
    (16, "apache/text", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + PROSE * 20),
    (17, "apache/x.c", PROSE),
    (18, "bsd3/LICENSE", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\nNeither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"),
    (19, "bsd2/LICENSE", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"),
    (20, "noa/x", "You can redistribute it under the terms of the GNU General Public License, either version 2 of the License, or any later version"),
    (21, "nob/x", "GNU Lesser General Public License, version 3"),
    (22, "noc/x", "BSD 2-Clause License"),
    (23, "nod/x", "Licensed under CC BY-ND 4.0"),
    (24, "noe/x", "Apache License, Version 1.1"),
]
OWN = {12: "GPL-3.0", 14: "ISC", 16: "Apache-2.0", 18: "BSD-3-Clause", 19: "BSD-2-Clause", 20: "GPL-2.0", 21: "LGPL-3.0", 22: "BSD-2-Clause", 23: None, 24: None}


def test_scan(spark):
    frame = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    got = [(r.doc_id, r.path, r.own_licence, r.licence, r.licence_path, r.inherited) for r in L.scan_licences(frame).collect()]
    assert sorted(got, key=str) == plain_scan(ROWS)
    by_id = {r[0]: r for r in got}
    assert by_id[2][3] == "MIT" and by_id[4][3] == "MIT" and by_id[6][3] == "Apache-2.0" and by_id[10][2] == "CC-BY-NC-4.0"
    assert by_id[11][2] is None and by_id[7][3] is None
    assert {k: by_id[k][2] for k in OWN} == OWN
    # headers do not govern, texts of licences do
    assert by_id[13][3] is None and by_id[15][3] == "ISC" and by_id[17][3] == "Apache-2.0"


def test_statement_is_the_text_at_its_place(spark):
    frame = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    texts = {r[0]: r[2] for r in ROWS}
    for r in L.scan_licences(frame).where("statement is not null").collect():
        assert texts[r.doc_id][r.place :].startswith(r.statement)


def test_documents_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.path, r.text) for r in L.document_paths(docs).collect()]
    got = L.op10_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.path, r.own_licence, r.licence, r.licence_path, r.inherited) for r in got), key=str) == plain_scan(rows)


def test_empty_table(spark):
    assert L.scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


TEXTS = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not all((FOLDER / n).exists() for n in TEXTS), reason="the system has no licence texts")
def test_texts_of_licences(spark):
    """Whole texts are known for what they are, and govern the files beside them whatever their own name."""
    rows = [(i, f"{n}/text", (FOLDER / n).read_text(), "x", "y") for i, n in enumerate(TEXTS)]
    rows += [(100 + i, f"{n}/src/code.py", PROSE, "x", "y") for i, n in enumerate(TEXTS)]
    got = {r.path: r for r in L.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n: got[f"{n}/text"].own_licence for n in TEXTS} == TEXTS
    titled = [n for n in TEXTS if n not in ("BSD", "CC0-1.0")]
    assert {n: got[f"{n}/src/code.py"].licence for n in titled} == {n: TEXTS[n] for n in titled}
