"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into pieces at line ends, after . ! ? : ; before white space and after list marks; a piece is normalised to
lower-case words, so comment prefixes go. A known sentence is a piece or several that follow each other, so it may be
wrapped over lines; it does not reach over an empty line or a sentence end. Known sentences have identifiers. The
identifiers found in a text, in their order, are matched with ordered rules: a rule is a sequence of identifiers that must
follow each other (unknown sentences between them do not count); what a rule has matched is used up, so an earlier rule
wins over a later one that needs the same sentences.

Only texts that contain the longest word of some known sentence are cut; every sentence contains its own. Comment prefixes
that are words and hyphenated line ends are not undone. Known sentences are one pattern, branched by first words; it is
tried where a piece begins. Rows are judged one by one: nothing is moved, repeated rows get equal rows, and other columns
do no harm. Null and empty texts have no sentence and no licence. Of equal sentences with several identifiers the last one
counts. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.tables import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences of common licences and notices, by identifier.
SENTENCES = {
    "apache_notice": "Licensed under the Apache License, Version 2.0.",
    "apache_compliance": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit_notice": "Released under the MIT License.",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0.",
    "cc_by_notice": "Licensed under CC BY 4.0.",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "rights_reserved": "All rights reserved.",
}
#: Ordered rules: licence and the identifiers that must follow each other.
RULES = [
    ("MIT", ["mit_grant", "mit_condition"]),
    ("GPL-3.0-or-later", ["gpl_grant", "gpl_warranty"]),
    ("Apache-2.0", ["apache_notice", "apache_compliance", "apache_copy"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant"]),
    ("Apache-2.0", ["apache_notice"]),
    ("MIT", ["mit_notice"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("all-rights-reserved", ["rights_reserved"]),
]
#: Sentences and rules beside those in the SQL; the rules come first, as they are longer.
MORE_SENTENCES = {
    "apache_header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl2_grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21_grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
MORE_RULES = [
    ("GPL-2.0-or-later", ["gpl2_grant", "gpl_warranty"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_header", "apache_compliance", "apache_copy", "apache_basis"]),
    ("Apache-2.0", ["apache_header", "apache_compliance", "apache_copy"]),
    ("Apache-2.0", ["apache_header"]),
    ("GPL-2.0-or-later", ["gpl2_grant"]),
    ("LGPL-2.1-or-later", ["lgpl21_grant"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("ISC", ["isc_grant"]),
]


def plain(sentence: str) -> str:
    """The normal form, for the tables; ``pieces`` is the same for columns."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def anchors(sentences: dict[str, str]) -> str:
    """A pattern that every known sentence matches: its longest word."""
    longest = {max(plain(s).split(" "), key=lambda w: (len(w), w)) for s in sentences.values()}
    return "|".join(sorted(longest))


def pieces(text: Column) -> Column:
    """The normal pieces of a text, each between line ends; | is where no sentence goes on."""
    t = F.regexp_replace(F.translate(text, UPPER + "|", LOWER + " "), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)^([^a-z0-9\n]*[a-z0-9]{1,2}\))[ \t]", "$1\n")  # list marks; 1. ends like a sentence
    t = F.regexp_replace(t, r"((?<!\bv)[.!?])[ \t\n]+", "$1\n|\n")
    t = F.regexp_replace(t, r"([a-z0-9'\")][:;]['\")]?|\bv\.)[ \t]+(?=[^ \t\n])", "$1\n")
    t = F.regexp_replace(t, r"\n[^a-z0-9\n|]*(?=\n)", "\n|")  # empty but for a comment prefix
    t = F.regexp_replace(t, r"[^a-z0-9\n|]+", " ")
    return F.concat(F.lit("\n"), F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit("\n"))


def pattern(sentences: Iterable[str]) -> str:
    """A pattern for the longest known sentence that begins after a line end, in any wrapping; branched by first words."""
    by_first = defaultdict(list)
    for s in sorted(sentences, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by_first[first].append("".join(f"[ \\n]{w}" for w in rest.split(" ") if w))
    branches = [f"{first}(?:{'|'.join(f'{r}(?= ?\\n)' for r in rest)})" for first, rest in sorted(by_first.items())]
    return r"(?<=\n ?)(?=(" + "|".join(branches) + "))"


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences, in order, as ``<id>`` each in one string."""
    size = 1 << max(4, len(sentences).bit_length())
    classes: list[list[tuple[str, str]]] = [[] for _ in range(size)]
    known = {plain(s): i for i, s in sentences.items() if plain(s)}
    for s, i in known.items():
        classes[len(s) % size].append((s, i))
    empty = F.create_map().cast("map<string,string>")
    table = F.array(*[F.create_map(*[F.lit(x) for pair in c for x in pair]) if c else empty for c in classes])
    runs = F.regexp_extract_all(pieces(text), F.lit(pattern(known) if known else "(?!)()"), F.lit(1))
    found = F.transform(F.transform(runs, lambda s: F.translate(s, "\n", " ")), lambda s: F.try_element_at(F.element_at(table, (F.length(s) % size) + 1), s))
    joined = F.array_join(F.transform(F.filter(found, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    return F.when(F.translate(text, UPPER, LOWER).rlike(anchors(sentences)), joined).otherwise("")


def matched(found: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """struct(rest, licences): what no rule has used, and the licences of the rules that matched, in order of the rules."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules])
    start = F.struct(found.alias("rest"), F.array().cast("array<string>").alias("licences"))
    step = lambda a, r: F.struct(F.replace(a.rest, r.ids, F.lit("|")).alias("rest"), F.when(F.contains(a.rest, r.ids), F.array_union(a.licences, F.array(r["name"]))).otherwise(a.licences).alias("licences"))
    return F.aggregate(table, start, step)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES | MORE_SENTENCES, rules: list[tuple[str, list[str]]] = MORE_RULES + RULES) -> DataFrame:
    """(key, sentence_ids, licences, unmatched) of every row: three strings, empty where there is nothing."""
    df = docs.select(F.col(key).alias(key), identifiers(F.coalesce(F.col(text), F.lit("")), sentences).alias("sentence_ids"))
    df = df.withColumn("m", F.when(F.col("sentence_ids") != "", matched(F.col("sentence_ids"), rules)))
    rest = F.regexp_replace(F.coalesce("m.rest", F.lit("")), r"\|", "")
    return df.select(key, "sentence_ids", F.coalesce(F.array_join("m.licences", ","), F.lit("")).alias("licences"), rest.alias("unmatched"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = {plain(s): i for i, s in SENTENCES.items()}
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in known.items())
    steps = []
    for k, (name, ids) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{k + 1} AS (SELECT doc_id, n, sentence_ids, replace(rest, '{pattern}', '|') AS rest, CASE WHEN contains(rest, '{pattern}') AND NOT list_contains(l, '{name}') THEN list_append(l, '{name}') ELSE l END AS l FROM r{k})")
    return f"""
WITH known(s, id) AS (VALUES {pairs}),
d AS (SELECT doc_id, row_number() OVER () AS n, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS x FROM documents),
e AS (SELECT n, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM d),
f AS (SELECT e.n, string_agg('<' || id || '>', '' ORDER BY k) AS ids FROM e JOIN known ON known.s = trim(regexp_replace(translate(e.s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ') GROUP BY e.n),
r0 AS (SELECT doc_id, d.n, coalesce(ids, '') AS sentence_ids, coalesce(ids, '') AS rest, CAST([] AS VARCHAR[]) AS l FROM d LEFT JOIN f ON f.n = d.n),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(l, ',') AS licences, replace(rest, '|', '') AS unmatched FROM r{len(RULES)}
"""


ORACLE = _oracle()
