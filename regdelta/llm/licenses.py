"""Licence scans: TF-IDF cosine to templates, then inheritance down the directories.

A file is cut into segments: lines and the sentences in them, sentences that are wrapped over several
lines, and paragraphs of several sentences; comment marks are no terms. A segment's terms
are weighed by their count times their inverse document frequency over the sentences of all
files, and compared with the templates (headers, grants, titles) by the cosine of the sparse vectors:
only terms of the templates have a product, all others lengthen the segment's vector. Versions and
qualifiers have to agree besides: a template's numbers stand in the segment, and words like lesser
or sharealike are in both or in neither. The best segment gives the file's own licence. A file
governs its directory if it is named like a licence file, opens with a licence's title, or is mostly
licence segments; a file without a licence of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, python_tasks, table

#: (licence, statement): how files commonly state each licence, sentences and whole grants.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "You can redistribute it under the terms of the GNU General Public License, either version 2 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: (licence, title): what the text of a licence opens with.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)
#: Words that tell licences of one family apart.
QUALIFIERS = frozenset("lesser library affero nc noncommercial nd noderivs noderivatives sa sharealike".split())
#: A licence whose own clause stands beside the text of another one has that text as a part.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}
SIMILARITY = 0.75
#: Share of a file's characters in licence segments that makes it a licence file.
MOSTLY = 0.5
TERM = regex.compile(r"[\p{L}\p{N}]+(?:\.\p{N}+)*")
SEGMENT = regex.compile(r"[^\n]*?(?:[.;](?=\s)|\n|$)")
#: A line without a letter or digit parts paragraphs.
PARAGRAPH = regex.compile(r"(?:[^\p{L}\p{N}\n]*\n)*((?:[^\n]*[\p{L}\p{N}][^\n]*(?:\n|$))+)")
SENTENCE = regex.compile(r"[^.;]*(?:[.;](?!\s)[^.;]*)*(?:[.;](?=\s)|[.;]?$)")
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"


def terms(segment: str) -> list[str]:
    return TERM.findall(segment.lower())


def _stripped(start: int, segment: str) -> tuple[int, str]:
    return start + len(segment) - len(segment.lstrip()), segment.strip()


def segments(text: str) -> Iterator[tuple[int, str]]:
    """(place, segment) of every sentence, at most a line."""
    for m in SEGMENT.finditer(text):
        at, s = _stripped(m.start(), m.group())
        if s:
            yield at, s


def wrapped(text: str, may_hold=None) -> Iterator[tuple[int, str]]:
    """(place, segment) of the sentences that stand on several lines, and of paragraphs of several sentences or lines; of the paragraphs that may hold a licence."""
    for p in PARAGRAPH.finditer(text):
        at, body = _stripped(p.start(1), p.group(1))
        if may_hold and not may_hold(body):
            continue
        parts = [_stripped(at + m.start(), m.group()) for m in SENTENCE.finditer(body)]
        parts = [(i, s) for i, s in parts if s]
        yield from ((i, s) for i, s in parts if "\n" in s)
        if len(parts) > 1:
            yield at, body


def segment_frequencies(files: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of segments of all files, and of those with each template term: one row a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("body").to_pylist():
                for _, s in segments(text or ""):
                    seen[""] += 1
                    seen.update(vocabulary.intersection(terms(s)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    counted = files.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in counted}
    return found.pop("", 0), found


class Matcher:
    """Weights and template vectors; terms that no template has weigh as much as a middling template term.

    markers: a segment without any of these cannot reach the similarity. Of each template
    the shortest and then the most frequent terms are left out as long as all of them together would stay below it;
    a template that needs a longer number or qualifier is marked by that alone. Markers are whole terms.
    """

    def __init__(self, templates, total: int, frequency: dict[str, int], similarity: float = SIMILARITY):
        bags = [(name, Counter(terms(text))) for name, text in templates]
        words = sorted({w for _, bag in bags for w in bag})
        self.idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in words}
        self.other = sorted(self.idf.values())[len(words) // 2] if words else 1.0
        self.posting: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in bags]
        self.told = [frozenset(w for w in bag if w[0].isnumeric() or w in QUALIFIERS) for _, bag in bags]
        marks: set[str] = set()
        for i, (_, bag) in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items()))
            share = {w: n * self.idf[w] / norm for w, n in bag.items()}
            for w, x in share.items():
                self.posting.setdefault(w, []).append((i, x))
            needed = [w for w in self.told[i] if len(w) > 2]
            if needed:
                marks.add(max(needed, key=lambda w: (len(w), w)))
                continue
            common = 0.0
            for w in sorted(share, key=lambda w: (len(w) > 3, self.idf[w], w)):
                common += share[w] ** 2
                if math.sqrt(common) >= similarity - 1e-9:
                    marks.add(w)
        self.markers = sorted(marks)
        self.automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def may_hold(self, text: str) -> bool:
        if not self.markers:
            return False
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for m in self.markers:
                self.automaton.add_word(m, len(m))
            self.automaton.make_automaton()
        low = text.lower()
        for end, size in self.automaton.iter(low):
            if not low[end + 1 : end + 2].isalnum() and not (end >= size and low[end - size].isalnum()):
                return True
        return False

    def best(self, segment: str, first: int = 0) -> tuple[float, str | None]:
        """Similarity and licence of the nearest template, from the given one on."""
        bag = Counter(terms(segment))
        dots: dict[int, float] = {}
        for w in bag.keys() & self.posting.keys():
            x = bag[w] * self.idf[w]
            for i, y in self.posting[w]:
                dots[i] = dots.get(i, 0.0) + x * y
        if not dots:
            return 0.0, None
        norm = math.sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in bag.items()))
        qualified = QUALIFIERS.intersection(bag)
        agree = [(s / norm, self.names[i]) for i, s in dots.items() if i >= first and all(w in bag for w in self.told[i]) and qualified == self.told[i] & QUALIFIERS]
        score, name = max(agree, default=(0.0, None))
        return min(score, 1.0), name


def _opens(matcher: Matcher, first_title: int, text: str, similarity: float) -> bool:
    """Whether the first line or the first lines up to a paragraph's end are the title of a licence."""
    first = next(PARAGRAPH.finditer(text[: 1 << 10]), None)
    heads = [first.group(1), first.group(1).lstrip().split("\n")[0]] if first else []
    return any(matcher.best(h, first_title)[0] >= similarity for h in heads)


def own_licences(files: DataFrame, matcher: Matcher, first_title: int, similarity: float = SIMILARITY) -> DataFrame:
    """(id, path, own_licence, similarity, place, statement, text_of): the best segment of each file.

    Templates are titles from first_title on.

    text_of: the file is the text of a licence, as it opens with its title or is mostly licence segments.
    """
    held = files.sparkSession.sparkContext.broadcast(matcher)

    def scan(m: Matcher, text: str) -> tuple:
        best, found, spans = (0.0, None, None, None), set(), []
        lines = list(segments(text))
        size = sum(len(s) for _, s in lines)
        for at, s in chain(lines, wrapped(text, m.may_hold)):
            score, name = m.best(s) if m.may_hold(s) else (0.0, None)
            if score >= similarity:
                spans.append((at, at + len(s)))
                found.add(name)
                if score > best[0]:
                    best = (score, name, at, s)
        covered, end = 0, 0
        for a, b in sorted(spans):
            covered += max(0, b - max(a, end))
            end = max(end, b)
        name = next((k for k, part in CONTAINS.items() if best[1] == part and k in found), best[1])
        opens = _opens(m, first_title, text, similarity)
        return name, best[0] if name else None, best[2], best[3], bool(name) and (opens or covered >= MOSTLY * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            # files without a marker have no licence segment
            out = [
                (doc, path, *(scan(m, text) if text and m.may_hold(text) else (None, None, None, None, False)))
                for doc, path, text in zip(b.column("id").to_pylist(), b.column("path").to_pylist(), b.column("body").to_pylist())
            ]
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "path", "own_licence", "similarity", "place", "statement", "text_of"])

    return files.mapInArrow(run, "id long, path string, own_licence string, similarity double, place long, statement string, text_of boolean")


def directory(path: Column) -> Column:
    """The folders before the last slash, without empty ones; empty for a file at the top."""
    folders = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    return F.array_join(F.filter(folders, lambda p: p != ""), "/")


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, with their depths; the top folder is empty and of depth 0."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("above"), k.alias("depth")))


def scan_licences(
    files: DataFrame, templates=TEMPLATES, titles=TITLES, similarity: float = SIMILARITY, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text"
) -> DataFrame:
    """doc_id, path, own_licence, similarity, place, statement, licence, licence_path, inherited: one row per input row.

    own_licence: template nearest to any segment, at the similarity or above; place and
    statement are that segment. Equal similarities take the first segment, and of templates
    the last licence by name; a licence that contains the one found has its own clause looked for
    in all segments (CONTAINS). licence: the own one, or that of the nearest folder at or above the
    file's that a licence file governs; licence_path is that file. Two licence files
    of a folder: the more similar governs, then the lesser path. Null texts count as
    empty and have no licence of their own; a null path lies in the top folder. Repeated rows
    are scanned alike; an empty input gives an empty result; other columns are not read.

    Folders are made distinct before they are resolved, so that a large folder is one row
    there, and the files are then joined with their folder alone.
    """
    spark = files.sparkSession
    python_tasks(spark)
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("body"))
    first_title, templates = len(templates), (*templates, *titles)
    total, frequency = segment_frequencies(rows, frozenset(w for _, t in templates for w in terms(t)))
    # a narrow row a file; it is used three times below
    found = cut(own_licences(rows, Matcher(templates, total, frequency, similarity), first_title, similarity), "licences")
    found = found.withColumn("folder", directory(F.coalesce("path", F.lit(""))))
    governs = found.where(F.col("own_licence").isNotNull() & (F.col("text_of") | F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False))))
    rules = governs.groupBy(F.col("folder").alias("above")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("licence_path"), F.col("own_licence").alias("licence"))).alias("rule")
    )
    above = found.select("folder").distinct().select("folder", F.inline(ancestors(F.col("folder"))))
    nearest = above.join(rules, "above").groupBy("folder").agg(F.max_by("rule", "depth").alias("rule"))
    out = found.join(nearest, "folder", "left")
    own = F.col("own_licence").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "path",
        "own_licence",
        "similarity",
        "place",
        "statement",
        F.coalesce("own_licence", "rule.licence").alias("licence"),
        F.when(own, F.col("path")).otherwise(F.col("rule.licence_path")).alias("licence_path"),
        (~own & F.col("rule").isNotNull()).alias("inherited"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files: source, then folders of a thousand and of a hundred ids."""
    shelf = lambda size: F.coalesce(F.floor(F.col("doc_id") / size).cast("string"), F.lit("none"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), shelf(1000), shelf(100), name).alias("path"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(document_paths(table(spark, sf_dir, "documents")))
