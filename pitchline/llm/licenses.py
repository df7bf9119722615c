"""Licence scans by sentence rules.

A text is cut into sentences, each normalised sentence that is a known licence
sentence becomes its identifier and any other one an unknown mark, and the
sequence of identifiers is matched against ordered licence rules: at each place
the first rule in order whose identifiers follow each other there wins
(German, Manabe and Inoue, 2010).  DataFrame functions only, one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col

# Licence sentences (normalised below) by identifier, the public
# wording of each licence's notice.  {} is a hole: a name, some words at most.
SENTENCES = (
    ("ApacheShort", "Licensed under the Apache License, Version 2.0"),
    ("ApacheHead", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MITShort", "Released under the MIT License"),
    ("MITShort", "Licensed under the MIT License"),
    ("MITGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITAsIs", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("BSDHead", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDEndorse", "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "Neither the name of {} nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorseInc", "Neither the name of {}. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDAsIs", 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("ISCGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Boost", "Distributed under the Boost Software License, Version 1.0"),
    ("LGPL21Redist", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL3Redist", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL3Redist", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("EPL2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("CCZEROWaiver", "To the extent possible under law, {} has waived all copyright and related or neighboring rights to {}"),
    ("SPDXMIT", "SPDX-License-Identifier: MIT"),
    ("SPDXApache2", "SPDX-License-Identifier: Apache-2.0"),
    ("SPDXBSD2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("SPDXBSD3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("SPDXGPL2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("SPDXGPL2Later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("SPDXGPL3Later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("SPDXMPL2", "SPDX-License-Identifier: MPL-2.0"),
    ("SPDXISC", "SPDX-License-Identifier: ISC"),
    ("GPL3Short", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL3Short", "Licensed under the GNU General Public License, version 3"),
    ("GPL2Short", "Licensed under the GNU General Public License, version 2"),
    ("GPL3Redist", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL2Redist", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPLHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("MPL2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CCBY4", "Licensed under CC BY 4.0"),
    ("CCBYSA4", "Licensed under CC BY-SA 4.0"),
    ("CCBYNC4", "Licensed under CC BY-NC 4.0"),
    ("CCZERO", "Licensed under CC0 1.0"),
    ("Reserved", "All rights reserved"),
)

# Licence by the identifiers of its notice, in order of priority.
RULES = (
    ("Apache-2.0", ("ApacheHead", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("ApacheShort",)),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITShort",)),
    ("BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDEndorseInc", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDEndorseInc")),
    ("BSD-2-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDHead", "BSDSource", "BSDBinary")),
    ("ISC", ("ISCGrant",)),
    ("Zlib", ("ZlibGrant",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("Boost",)),
    ("LGPL-2.1-or-later", ("LGPL21Redist",)),
    ("LGPL-3.0-or-later", ("LGPL3Redist",)),
    ("AGPL-3.0-or-later", ("AGPL3Redist",)),
    ("EPL-2.0", ("EPL2",)),
    ("GPL-3.0-or-later", ("GPL3Redist", "GPLHope")),
    ("GPL-3.0-or-later", ("GPL3Redist",)),
    ("GPL-2.0-or-later", ("GPL2Redist", "GPLHope")),
    ("GPL-2.0-or-later", ("GPL2Redist",)),
    ("GPL-3.0-only", ("GPL3Short",)),
    ("GPL-2.0-only", ("GPL2Short",)),
    ("MPL-2.0", ("MPL2",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC0-1.0", ("CCZERO",)),
    ("CC0-1.0", ("CCZEROWaiver",)),
    ("MIT", ("SPDXMIT",)),
    ("Apache-2.0", ("SPDXApache2",)),
    ("BSD-2-Clause", ("SPDXBSD2",)),
    ("BSD-3-Clause", ("SPDXBSD3",)),
    ("GPL-2.0-only", ("SPDXGPL2",)),
    ("GPL-2.0-or-later", ("SPDXGPL2Later",)),
    ("GPL-3.0-or-later", ("SPDXGPL3Later",)),
    ("MPL-2.0", ("SPDXMPL2",)),
    ("ISC", ("SPDXISC",)),
    ("all-rights-reserved", ("Reserved",)),
)

UNKNOWN = "?"
# A sentence ends at a line end or at . ! ? ; : before white space.  Lines are
# joined first where the next one goes on in lower case or with a bracket (wrapped
# notices); it may begin with comment marks.
END = r"[\n\r]+|[.!?;:][ \t\n\r]+"
OTHER = r"[^\p{L}\p{N}]+"
COMMENTED = r"\r?\n[ \t]*(?:(?:\*+|//+|#+|;+|%+|--+|>+|!+)[ \t]+)*([a-z(])"
# List numbers are no words of a sentence: alone they are dropped, before one they
# are cut.
NUMBER = r"(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})"
HOLE, IN_HOLE = "xholex", r"[\p{L}\p{N} ]{1,100}"


def normalised(sentence: str) -> str:
    """The key of a fixed sentence, as the expression in ``scan`` makes it."""
    import re
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def parts_of(text: str) -> list[str]:
    """Keys of the sentences of a notice; a hole is the word ``HOLE``."""
    import re
    return [n for p in re.split(END, text.replace("{}", HOLE) + "\n") if (n := normalised(p))]


def keys(sentences=SENTENCES) -> dict[str, str]:
    """Identifier by key; a notice that itself holds a sentence end (``; : .``) is
    known by its parts, each with the notice's identifier and the part's number.
    A part that several notices share (GPL-2 and GPL-3 begin alike) has one."""
    out: dict[str, str] = {}
    for name, text in sentences:
        parts = parts_of(text)
        for i, p in enumerate(parts):
            out[p] = name if len(parts) == 1 else f"{name}.{i + 1}"
    return out


def templates(sentences=SENTENCES) -> list[tuple[str, str]]:
    """(pattern, identifier) of the keys with holes, the longest first."""
    known = [(k, v) for k, v in keys(sentences).items() if HOLE in k]
    return [(f"^(?:{NUMBER} )?{k.replace(HOLE, IN_HOLE)}$", v) for k, v in sorted(known, key=lambda kv: -len(kv[0]))]


def scan_patterns(sentences=SENTENCES, rules=RULES) -> dict[str, str]:
    """Licence by the identifier string of its rule, longer rules of a licence
    before shorter ones, otherwise in order of the rules."""
    known, named = keys(sentences), {}
    for name, text in sentences:
        named.setdefault(name, []).append("".join(f"<{known[p]}>" for p in parts_of(text)))
    out: dict[str, str] = {}
    for licence, ids in rules:
        strings = [""]
        for i in ids:                                    # the wordings of one identifier may have different parts
            strings = [a + b for a in strings for b in dict.fromkeys(named[i])]
        for x in strings:
            out.setdefault(x, licence)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """(id, licence, identifiers, occurrences): per row of ``docs`` each rule
    that matches its whole text and how often.

    List numbers and the comment marks of wrapped lines belong to no sentence; a
    hole of a sentence takes up to 100 characters of words.  Null and empty texts
    match nothing.  Rows that share an id are scanned each; equal rows give equal
    results.  Nothing is shuffled but the matches.
    """
    known = {k: v for k, v in keys(sentences).items() if HOLE not in k}
    holed, patterns = templates(sentences), scan_patterns(sentences, rules)
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    licences = F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv])
    anyrule = "|".join(p.replace(".", r"\.") for p in patterns)
    text = F.regexp_replace(F.coalesce(col(text_col).cast("string"), F.lit("")), COMMENTED, " $1")
    clean = F.transform(F.split(text, END), lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " ")))

    def in_hole(s):
        if not holed:
            return F.lit(None).cast("string")
        which = F.lit(None).cast("string")
        for pattern, name in reversed(holed):
            which = F.when(s.rlike(pattern), F.lit(name)).otherwise(which)
        return F.when(s.rlike("|".join(p for p, _ in holed)), which)

    name = lambda s: F.coalesce(
        F.try_element_at(ids, s), F.when(s.rlike(f"^{NUMBER} "), F.try_element_at(ids, F.regexp_replace(s, f"^{NUMBER} ", ""))),
        in_hole(s), F.when(s.rlike(r"\p{L}") & ~s.rlike(f"^{NUMBER}$"), F.lit(UNKNOWN)))
    marks = F.transform(F.filter(F.transform(clean, name), lambda n: n.isNotNull()), lambda n: F.concat(F.lit("<"), n, F.lit(">")))
    d = docs.select(col(id_col).alias("id"), F.array_join(marks, "").alias("seq"))
    d = d.withColumn("hits", F.regexp_extract_all("seq", F.lit(f"({anyrule})"), F.lit(1))).where(F.size("hits") > 0)
    each = d.select("id", F.col("hits"), F.explode(F.array_distinct("hits")).alias("identifiers"))
    return each.select(F.col("id").alias(id_col), F.try_element_at(licences, F.col("identifiers")).alias("licence"), "identifiers",
                       F.size(F.filter("hits", lambda h: h == F.col("identifiers"))).cast("long").alias("occurrences"))


def op5_license_rules(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same sentences and rules as joins: exact keys, keys behind a list
    number, holes, then unknown; pieces without a letter go."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in keys().items() if HOLE not in k)
    patterns = scan_patterns()
    licences = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in patterns.items())
    anyrule = "|".join(p.replace(".", r"\.") for p in patterns)

    def in_hole(key: str) -> str:
        """Condition on x: the words around its holes, and the holes' lengths."""
        first, *rest = key.split(HOLE)
        if len(rest) == 1:
            size = len(first) + len(rest[0])
            return f"starts_with(x, {quote(first)}) AND ends_with(x, {quote(rest[0])}) AND length(x) BETWEEN {size + 1} AND {size + 100}"
        middle, last = rest                              # two holes at most
        at = f"instr(x, {quote(middle)})"
        return (f"starts_with(x, {quote(first)}) AND ends_with(x, {quote(last)}) AND {at} BETWEEN {len(first) + 2} AND {len(first) + 101} "
                f"AND length(x) - {at} BETWEEN {len(middle) + len(last)} AND {len(middle) + len(last) + 99}")

    held = sorted(((k, v) for k, v in keys().items() if HOLE in k), key=lambda kv: -len(kv[0]))
    holes = " ".join(f"WHEN {in_hole(k)} THEN {quote(v)}" for k, v in held)
    return rf"""
WITH known(s, name) AS (VALUES {known}),
rules(identifiers, licence) AS (VALUES {licences}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '{COMMENTED}', ' \1', 'g') AS t FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, string_split_regex(t, '{END}') AS parts FROM d),
s AS (SELECT r, doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM p),
n0 AS (SELECT r, doc_id, i, trim(regexp_replace(lower(raw), '{OTHER}', ' ', 'g')) AS s FROM s),
n AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(s, '^{NUMBER} ') THEN regexp_replace(s, '^{NUMBER} ', '') ELSE s END AS x FROM n0),
m AS (SELECT r, doc_id, i, coalesce(a.name, b.name, CASE {holes} END,
        CASE WHEN regexp_matches(n.s, '\p{{L}}') AND NOT regexp_full_match(n.s, '{NUMBER}') THEN '{UNKNOWN}' END) AS name
      FROM n LEFT JOIN known a ON a.s = n.s
      LEFT JOIN known b ON b.s = n.x),
q AS (SELECT r, doc_id, string_agg(concat('<', name, '>'), '' ORDER BY i) AS seq FROM m WHERE name IS NOT NULL GROUP BY r, doc_id),
h AS (SELECT r, doc_id, unnest(regexp_extract_all(seq, '({anyrule})')) AS identifiers FROM q)
SELECT doc_id, licence, identifiers, CAST(count(*) AS BIGINT) AS occurrences
FROM h JOIN rules USING (identifiers) GROUP BY r, doc_id, licence, identifiers
"""


OP5_SQL = _sql()
