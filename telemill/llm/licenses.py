"""License scan by sentence rules, in one projection without a shuffle.

A text is cut into sentences, each is normalised and mapped to the identifier of a known licence sentence, and
the sequence of identifiers is matched against ordered rules.  Sentences are cut in three ways: at line ends and
sentence ends; at sentence ends of the joined lines with comment marks removed (a wrapped notice); and so too, but
with blank lines as sentence ends (a title or copyright line before the notice).  Rules are matched in each of them
and all hits count; the identifiers told are those of the way that recognises most, the first one on a tie.

A text without any of KEYWORDS cannot hold a known sentence and isn't cut.  Rules match as a run of neighbouring
identifiers; identifiers that no matched rule uses are counted as unmatched.

Defined cases: null and empty texts have no sentences; repeated rows stay separate; columns other than the id
and the text are never read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import text_of

# fixed values: known licence sentences (normalised) and their identifiers
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by 4 0": "cc-by4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-grant",
    "all rights reserved copyright": "reserved",
}
# fixed values: units that the cut makes of official notices with marks inside a sentence, and further official wordings
NOTICES = {
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-published",
    "either version 3 of the license or at your option any later version": "gpl3-either",
    "either version 2 of the license or at your option any later version": "gpl2-either",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4",
    "the mit license mit": "mit-title",
}
# fixed values: a licence and the ordered identifiers that state it
RULES = [
    ("Apache-2.0", ["apache2-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-limits"]),
    ("Apache-2.0", ["apache2-grant", "apache-comply"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("BSD", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("MPL-2.0", ["mpl2-grant"]),
]
NOTICE_RULES = [
    (f"GPL-{v}.0-or-later", free + terms + warranty)
    for v in (3, 2)
    for terms in ([f"gpl{v}-terms"], ["gpl-published", f"gpl{v}-either"])
    for free in (["gpl-free"], [])
    for warranty in (["gpl-hope", "gpl-implied", "gpl-details"], [])
]
# fixed values: further official notices, and how many of their units name the licence
TEXTS = [
    ("ISC", 1, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", 1, """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("LGPL-2.1-or-later", 3, """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0-or-later", 2, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0-or-later", 2, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("EPL-2.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("BSD-3-Clause", 4, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", 4, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Zlib", 3, """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("BSL-1.0", 1, "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", 1, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", 1, "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("MIT", 4, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
# fixed values: every known sentence holds one of these
KEYWORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "as is", "free software", "public domain", "liab", "free to copy", "loss of use", "business interruption")

_CUT = "\x01"


def units_of(text: str) -> list[str]:
    """The normalised units that the cut makes of a text, lines joined."""
    joined = re.sub(r"\s*\n[\s#*/;%-]*", " ", text.lower())
    plain = [re.sub("[^a-z0-9\x80-\U0010FFFF]+", " ", u).strip() for u in re.sub(r"(?!(?<=\bv)\.\s+\d)([.!?;:])\s+", f"\\1{_CUT}", joined).split(_CUT)]
    return [u for u in plain if u]


def _book() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All known sentences and all rules: TEXTS give a rule for the units that name the licence, and one for all of them."""
    known, rules = SENTENCES | NOTICES, RULES + NOTICE_RULES
    for name, naming, text in TEXTS:
        ids = [known.setdefault(u, f"{name.lower()}-{k}") for k, u in enumerate(units_of(text), 1)]
        rules = rules + [r for r in ((name, ids), (name, ids[:naming])) if r not in rules]
    return known, rules


KNOWN, ALL_RULES = _book()


def unmatchable() -> list[str]:
    """Known sentences that no keyword would let through; must be empty."""
    return [s for s in KNOWN if not any(k in s for k in KEYWORDS)]


def _cut(text: Column) -> Column:
    """Cut behind sentence marks; the point of "v. 2.0" is none."""
    return F.split(F.regexp_replace(text, "(?!(?<=\\bv)\\.\\s+\\d)([.!?;:])\\s+", f"$1{_CUT}"), _CUT)


def _identify(units: Column) -> Column:
    """(at, id) of the known units: how many letters and digits stand before each, and its identifier."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    plain = F.transform(units, lambda u: F.trim(F.regexp_replace(u, "[^a-z0-9\\x80-\\x{10FFFF}]+", " ")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,id:string>>").alias("found"))

    def step(out: Column, u: Column) -> Column:
        found = F.array(F.struct(out["at"].alias("at"), F.element_at(known, u).alias("id")))
        return F.struct((out["at"] + F.length(F.replace(u, F.lit(" "), F.lit("")))).alias("at"), F.when(F.element_at(known, u).isNotNull(), F.concat(out["found"], found)).otherwise(out["found"]).alias("found"))

    return F.aggregate(plain, start, step, lambda out: out["found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, sentences (identifiers in order), licenses (names in order of the alphabet), n_known, n_unmatched."""
    low = F.lower(text_of(text_col))
    none = F.array().cast("array<struct<at:int,id:string>>")
    worth = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in KEYWORDS])
    rows = docs.select(F.col(id_col).alias("_id"), F.when(worth, low).otherwise("").alias("_low"))
    lines = _identify(_cut(F.regexp_replace("_low", "\\n", _CUT)))
    joined = lambda t: _identify(_cut(F.regexp_replace(t, "\\s*\\n[\\s#*/;%-]*", " ")))
    parted = F.regexp_replace("_low", "\\n[\\s#*/;%-]*\\n[\\s#*/;%-]*", _CUT)
    views = {"_lines": lines, "_wrapped": joined(F.col("_low")), "_parted": joined(parted)}
    rows = rows.select("_id", *[F.when(F.col("_low") == "", none).otherwise(view).alias(name) for name, view in views.items()])
    merged = F.sort_array(F.array_union(F.array_union("_lines", "_wrapped"), F.col("_parted")))
    rows = rows.withColumn("_ids", F.transform(merged, lambda x: x["id"]))
    told = F.concat(*[x for name in views for x in (F.lit("|"), F.array_join(F.transform(name, lambda x: x["id"]), "|"), F.lit("|\n"))], F.lit("|"), F.array_join("_ids", "|"), F.lit("|"))
    rows = rows.select("_id", "_ids", told.alias("_told"))
    hits = F.array(*[F.when(F.contains("_told", F.lit("|" + "|".join(ids) + "|")), F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, ids)).alias("ids"))) for name, ids in ALL_RULES])
    rows = rows.withColumn("_hits", F.filter(hits, lambda x: x.isNotNull()))
    used = F.flatten(F.transform("_hits", lambda x: x["ids"]))
    return rows.select(
        F.col("_id").alias(id_col),
        F.array_join("_ids", "|").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["name"]))), "|").alias("licenses"),
        F.size("_ids").cast("long").alias("n_known"),
        F.size(F.filter("_ids", lambda x: ~F.array_contains(used, x))).cast("long").alias("n_unmatched"),
    )


def _oracle() -> str:
    """The same rule in SQL, written without lookbehind: the point of "v. 2.0" is hidden from the cut."""
    quote = lambda s: "'" + s + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in KNOWN.items())
    rules = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, ids))}], {quote('|' + '|'.join(ids) + '|')})" for k, (name, ids) in enumerate(ALL_RULES))
    worth = " OR ".join(f"contains(lower(text), {quote(k)})" for k in KEYWORDS)
    cut = lambda t: f"string_split(regexp_replace(regexp_replace({t}, '\\bv\\.(\\s+\\d)', 'v' || chr(2) || '\\1', 'g'), '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    joined = lambda t: f"regexp_replace({t}, '\\s*\\n[\\s#*/;%-]*', ' ', 'g')"
    parted = "regexp_replace(t, '\\n[\\s#*/;%-]*\\n[\\s#*/;%-]*', chr(1), 'g')"
    return f"""
WITH known(s, i) AS (VALUES {known}), rules(k, name, ids, told) AS (VALUES {rules}),
low AS (SELECT doc_id, lower(text) AS t FROM documents WHERE {worth}),
views AS (SELECT doc_id, 1 AS v, {cut("replace(t, chr(10), chr(1))")} AS u FROM low
          UNION ALL SELECT doc_id, 2, {cut(joined("t"))} FROM low
          UNION ALL SELECT doc_id, 3, {cut(joined(parted))} FROM low),
cells AS (SELECT doc_id, v, unnest(u) AS u, unnest(range(1, len(u) + 1)) AS pos FROM views),
units AS (SELECT doc_id, v, pos, trim(regexp_replace(u, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) AS u FROM cells),
placed AS (SELECT doc_id, v, u, coalesce(sum(length(replace(u, ' ', ''))) OVER (PARTITION BY doc_id, v ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM units),
hit AS (SELECT doc_id, v, p, i FROM placed JOIN known ON s = u),
merged AS (SELECT doc_id, list(i ORDER BY p, i) AS ids FROM (SELECT DISTINCT doc_id, p, i FROM hit) GROUP BY doc_id),
told AS (SELECT doc_id, '|' || string_agg(i, '|' ORDER BY p) || '|' AS told FROM hit GROUP BY doc_id, v
         UNION ALL SELECT doc_id, '|' || array_to_string(ids, '|') || '|' FROM merged),
won AS (SELECT DISTINCT b.doc_id, r.k, r.name, r.ids FROM told b JOIN rules r ON contains(b.told, r.told)),
named AS (SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS licenses, flatten(list(ids)) AS used FROM won GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(m.ids, '|'), '') AS sentences, coalesce(n.licenses, '') AS licenses, coalesce(len(m.ids), 0) AS n_known,
       coalesce(len(list_filter(m.ids, lambda x: NOT coalesce(list_contains(n.used, x), FALSE))), 0) AS n_unmatched
FROM documents d LEFT JOIN merged m ON d.doc_id = m.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


ORACLE = _oracle()
