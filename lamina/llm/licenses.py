"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at . ; : ! ? before white space and at blank lines. A sentence that runs over
several lines is joined, whatever its comment marks and its width: of the lines of a sentence the longest run up to its end
that is a known one counts, and the lines before it each for themselves (titles and mentions without a full stop).
Sentences are normalised (A-Z lower-cased, all but a-z, 0-9 and . turned into single spaces, outer spaces and
dots and a list number in front removed) and mapped to the identifier of a known licence sentence. The identifiers of a document, in
order, without the unknown sentences between them, are matched against rules: each rule is a sequence of
identifiers that must occur in direct succession. A match that lies inside a longer one, by its places,
adds nothing; the same sentences elsewhere in the text count.

Names of holders that a notice fills in stand for the words of the known sentence. A tag that names one of TAGS is a sentence of its own, with its colon;
a tag with an expression gives nothing.

A text without any of the ANCHORS, one of which is in each known sentence, has none and is not cut.
Everything happens inside a row: no shuffle, no join. Defined cases: null and empty texts have no sentence
and no licence; repeated rows each get a result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier (fixed values: the official texts).
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-title": "Apache License, Version 2.0",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-copy-at": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl3-version": "either version 3 of the License, or (at your option) any later version",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-only-version": "version 2 of the License",
    "gpl3-only-version": "version 3 of the License",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl-free": "This library is free software",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "apache-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "gpl2-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "mpl-source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "This work has been dedicated to the public domain under CC0 1.0",
}

#: Rules: licence and sentence identifiers in order (fixed values).
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-title", "isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy-at", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl3-version"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl2-version"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-only-terms"]),
    ("GPL-2.0-only", ["gpl-free", "gpl-terms", "gpl2-only-version"]),
    ("GPL-3.0-only", ["gpl-free", "gpl-terms", "gpl3-only-version"]),
    ("Apache-2.0", ["apache-text"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-2.0", ["gpl2-work"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "lgpl21-version"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-source", "mpl-copy"]),
    ("MPL-2.0", ["mpl-source"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC0-1.0", ["cc0"]),
]

#: Identifiers that a tag may name (fixed values). A tag with an expression, or with another identifier, is no known sentence.
TAGS = [
    "MIT", "ISC", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "AGPL-3.0-or-later",
    "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "Unlicense", "Zlib", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0",
]
SENTENCES |= {f"tag-{t.lower()}": f"SPDX-License-Identifier: {t}" for t in TAGS}
RULES += [(t, [f"tag-{t.lower()}"]) for t in TAGS]

#: Each known sentence holds one of these (fixed values).
ANCHORS = ["licens", "redistribut", "software", "warranty", "mozilla", "mpl", "public domain", "this program is", "copyright"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences become the control character 1.
SENTENCE_END = r"[.;:!?]+[ \t\n\f\r]+|\n[ \t\f\r>#*/%-]*\n\s*"
NOISE = r"[^a-z0-9.\n\x01]+"
LIST_NUMBER = r"^[0-9]+ "
#: The full stop of a version (v. 2.0) does not end a sentence.
VERSION = r"([^a-z0-9])v\.[^a-z0-9]+([0-9])"
#: Places that a notice fills in, and what stands there in the known sentence. A holder has at most 20 words; it may hold full stops.
GAP = "[^a-z0-9]+"
HOLDER = f"(?:[a-z0-9]+{GAP}){{0,20}}?"
FILLED = [
    (f"neither{GAP}the{GAP}names?{GAP}of{GAP}{HOLDER}nor{GAP}the{GAP}names?{GAP}of{GAP}(?:its|their|any|other){GAP}contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (f"this{GAP}software{GAP}is{GAP}provided{GAP}by{GAP}{HOLDER}and{GAP}contributors{GAP}as{GAP}is{GAP}and", "this software is provided by the copyright holders and contributors as is and"),
    (f"spdx{GAP}license{GAP}identifier{GAP}", "spdx license identifier "),
]


def normalized(sentence: str) -> str:
    return re.sub(r"[^a-z0-9.]+", " ", re.sub(VERSION, r"\1v \2", sentence.lower())).strip(" .")


KNOWN = {normalized(s): i for i, s in SENTENCES.items()}
#: Lines that a known sentence can take at most: each has a word.
MOST_LINES = max(len(s.split()) for s in KNOWN)


def sentence_ids(text: Column) -> Column:
    """Array of the identifiers of a text's known sentences, in order; null for a null text."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    low = F.translate(text, UPPER, LOWER)
    flat = F.regexp_replace(reduce(lambda t, f: F.regexp_replace(t, f[0], f[1]), FILLED, low), VERSION, "$1v $2")
    flat = F.regexp_replace(F.regexp_replace(flat, SENTENCE_END, "\x01"), NOISE, " ")
    lines = F.transform(F.split(flat, "\x01"), lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.btrim(x, F.lit(" ."))), lambda x: x != ""))
    id_of = lambda s: F.element_at(known, F.regexp_replace(s, LIST_NUMBER, ""))
    run = lambda l, k: F.array_join(F.slice(l, F.size(l) - k + 1, k), " ")

    def ids(l: Column) -> Column:
        sizes = F.sequence(F.least(F.size(l), F.lit(MOST_LINES)), F.lit(1), F.lit(-1))
        longest = F.coalesce(F.get(F.filter(sizes, lambda k: id_of(run(l, k)).isNotNull()), F.lit(0)), F.lit(0))
        return F.transform(F.array(longest), lambda k: F.concat(F.transform(F.slice(l, F.lit(1), F.size(l) - k), id_of), F.array(F.when(k > 0, id_of(run(l, k))))))[0]

    found = F.array_compact(F.flatten(F.transform(F.filter(lines, lambda l: F.size(l) > 0), ids)))
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in ANCHORS]), found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_known, sentence_ids (comma-joined, in order), licenses (sorted, comma-joined)."""
    ids = F.coalesce(sentence_ids(F.col(text_col)), F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, r)).alias("ids")) for n, r in RULES])

    def of_rule(r: Column) -> Column:
        n = F.size(r["ids"])
        at = F.filter(F.sequence(F.lit(1), F.size("_ids")), lambda i: F.slice("_ids", i, n) == r["ids"])
        return F.transform(at, lambda i: F.struct(r["name"].alias("name"), i.alias("a"), (i + n).alias("b")))

    found = F.when(F.size("_ids") > 0, F.flatten(F.transform(rules, of_rule)))
    inside = lambda m: F.exists("_found", lambda o: (o["a"] <= m["a"]) & (o["b"] >= m["b"]) & (o["b"] - o["a"] > m["b"] - m["a"]))
    names = F.transform(F.filter("_found", lambda m: ~inside(m)), lambda m: m["name"])
    out = docs.select(F.col(id_col), ids.alias("_ids")).withColumn("_found", found)
    return out.select(id_col, F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit("")).alias("licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FILLED = reduce(lambda t, f: f"regexp_replace({t}, '{f[0]}', '{f[1]}', 'g')", FILLED, f"translate(text, '{UPPER}', '{LOWER}')")
_FLAT = f"regexp_replace({_FILLED}, '{VERSION}', '\\1v \\2', 'g')"
SQL = f"""
WITH known(id, s) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(s)})" for s, i in KNOWN.items())}),
rules(no, name, n, i, id) AS (VALUES {", ".join(f"({k}, {_quoted(name)}, {len(r)}, {i}, {_quoted(x)})" for k, (name, r) in enumerate(RULES) for i, x in enumerate(r))}),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({_FLAT}, '{SENTENCE_END}', chr(1), 'g'), '{NOISE}', ' ', 'g'), chr(1)) AS parts FROM documents),
seg AS (SELECT doc_id, string_split(unnest(parts), chr(10)) AS ls, generate_subscripts(parts, 1) AS pos FROM cut),
raw AS (SELECT doc_id, pos, trim(unnest(ls), ' .') AS l, generate_subscripts(ls, 1) AS ln FROM seg),
line AS (SELECT doc_id, pos, l, row_number() OVER (PARTITION BY doc_id, pos ORDER BY ln) AS n, count(*) OVER (PARTITION BY doc_id, pos) AS total FROM raw WHERE l <> ''),
run AS (SELECT doc_id, pos, n, regexp_replace(array_to_string(list(l) OVER (PARTITION BY doc_id, pos ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ' '), '{LIST_NUMBER}', '') AS s, total FROM line),
ends AS (SELECT doc_id, pos, min(n) AS n, arg_min(id, n) AS id FROM run JOIN known USING (s) WHERE total - n < {MOST_LINES} GROUP BY doc_id, pos),
found AS (SELECT doc_id, pos, n, id FROM ends UNION ALL
  SELECT l.doc_id, l.pos, l.n, k.id FROM line l JOIN known k ON regexp_replace(l.l, '{LIST_NUMBER}', '') = k.s LEFT JOIN ends e ON e.doc_id = l.doc_id AND e.pos = l.pos WHERE e.n IS NULL OR l.n < e.n),
ids AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, n) AS p FROM found),
seqs AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY p) AS seq FROM ids GROUP BY doc_id),
hits AS (SELECT doc_id, name, p - i AS a, p - i + n AS b FROM ids JOIN rules USING (id) GROUP BY doc_id, no, name, n, p - i HAVING count(*) = n),
kept AS (SELECT DISTINCT doc_id, name FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.b >= h.b AND o.b - o.a > h.b - h.a)),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(i.n, 0) AS BIGINT) AS n_known, coalesce(i.seq, '') AS sentence_ids, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN seqs i USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
