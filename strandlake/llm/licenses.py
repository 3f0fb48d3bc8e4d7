r"""License scan by canonical digests.

A text is made canonical: lower case, copyright lines dropped, equivalent spellings replaced, everything but letters and
digits turned to one space. The MD5 digest of the entire canonical text is looked up by a hash join among the digests of
known licence texts and notices. Three kinds of entire texts are looked up for a document: the document itself; its blocks,
parted by blank lines, if they have several lines; and each of its lines. So a licence pasted into a longer document, whose
paragraphs are known where one licence alone has them, and a notice on its own line are found within other prose. Long licences
are known by the digests of their entire texts, so they are found where they are the whole document.

Only texts that hold one of the anchor words can equal a known text (``known_digests`` asserts it), so digests of blocks and
lines are taken for those alone. A line ends with a line feed, a carriage return or both. Null and empty texts have the digest of
the empty string and no licence. Rows that share a doc_id are reported as one document. Texts may be of any length. An empty
table gives none. Further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical spelling of equivalent words (after lower-casing), as (pattern, replacement).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub[^a-z0-9]+license", "sublicense"),
    ("non[^a-z0-9]+commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("https://", "http://"),
    ("version ([0-9])", "v$1"),
)
COPYRIGHT = r"^[^a-z0-9\n]*(copyright *(\(c\)|©|:)|copyright[^\n]*[0-9]{4}|\(c\)|©)[^\n]*$"
OTHER = r"[^a-z0-9]+"
ANCHOR = "(?i)licen[cs]e|permission|spdx|released|distributed|available|software"
BREAK, BLANK = "\r\n?", "\n[ \t]*\n"
#: Words that a paragraph of a known text has at least to be known by itself.
LEAST_WORDS = 15

# Names under which notices cite licences.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL-2.0"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
# What stands before a name in a notice.
LEADS = (
    "Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under", "Distributed under the",
    "Available under the", "This work is licensed under", "This work is licensed under the", "This work is licensed under a",
    "This project is licensed under the", "This file is licensed under the", "SPDX-License-Identifier:",
)

# Whole texts of short licences.
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZERO_BSD_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Notices that stand at the head of files.
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
CC_NOTICE = "This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."

# By licence: whole texts, each with the titles that may stand above it.
TEXTS = {
    "0BSD": (ZERO_BSD_TEXT, ("BSD Zero Clause License", "Zero-Clause BSD")),
    "AGPL-3.0": (GNU_NOTICE.format(name="Affero General Public License", version=3), ()),
    "Apache-2.0": (APACHE_NOTICE, ()),
    "BSD-2-Clause": (f"{BSD_HEAD}\n\n{BSD_CLAUSES}\n\n{BSD_TAIL}", ("BSD 2-Clause License", "The 2-Clause BSD License")),
    "BSD-3-Clause": (f"{BSD_HEAD}\n\n{BSD_CLAUSES}\n\n{BSD_THIRD}\n\n{BSD_TAIL}", ("BSD 3-Clause License", "The 3-Clause BSD License")),
    "BSL-1.0": (BOOST_TEXT, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    "CC-BY-4.0": (CC_NOTICE.format(name="Attribution", code="by"), ()),
    "CC-BY-SA-4.0": (CC_NOTICE.format(name="Attribution-ShareAlike", code="by-sa"), ()),
    "CC-BY-NC-4.0": (CC_NOTICE.format(name="Attribution-NonCommercial", code="by-nc"), ()),
    "GPL-2.0": (GNU_NOTICE.format(name="General Public License", version=2), ()),
    "GPL-3.0": (GNU_NOTICE.format(name="General Public License", version=3), ()),
    "ISC": (ISC_TEXT, ("ISC License",)),
    "LGPL-3.0": (GNU_NOTICE.format(name="Lesser General Public License", version=3), ()),
    "MIT": (MIT_TEXT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    "MPL-2.0": (MPL_NOTICE, ()),
    "Unlicense": (UNLICENSE_TEXT, ()),
    "Zlib": (ZLIB_TEXT, ("zlib License",)),
}

# MD5 digests of the canonical entire texts of long licences, as their publishers give them (for the licences of 1991
# to 1999 with the address of either of two offices), and of their terms alone, up to the line END OF TERMS AND CONDITIONS.
LONG_TEXTS = {
    "Apache-2.0": (
        "3bf4dc73e128edc35de53a72210b1bc3",
        "9cd57d68db752e9bff12a1bad5293c28",
    ),
    "Artistic-1.0-Perl": ("a8b0fb0c6e43a3b36bdc159e59dbfd1e",),
    "CC0-1.0": ("93a180096f6cfcf2c0dd24f75c2eec48",),
    "GFDL-1.2": ("6e3c2d0a3783812fe27c95f27944bacf",),
    "GFDL-1.3": ("c8ca6943792d8c190d88dd07c2272037",),
    "GPL-1.0": (
        "e513b86acaafe4ee44051c6200fad91b",
        "90db245cacd09dd7f9bddc2bf92c4d4d",
    ),
    "GPL-2.0": (
        "c6e44c05da0bd121e39e1a00e8571ce4",
        "757dba826af7b629dff02d967b72ab8a",
        "91cb0ed6247e06c7b3ff3f1dcbf8aced",
        "e0f9b820882c5a623705c42e5d0f089d",
    ),
    "GPL-3.0": (
        "e4e09635b1d6f826dcf1e1ddb6682a27",
        "6affd9584153e5f043862de9ddecba3a",
    ),
    "LGPL-2.0": (
        "fd5c42bc693d3ad279cf7eb459c8d50b",
        "edf4d5584ce31ab1548eedc5dedc1d75",
        "563bc9311d80cd9a889d16e6baf1ecb6",
        "123566cf93d72ac8a942c998bc2a42e4",
    ),
    "LGPL-2.1": (
        "3f554d01f627f29bdce11767a44fd410",
        "1d08da8cbd5642055d95d42626eae017",
        "13f8d4f895b1fb439a062b2934777ed9",
        "513fcc1fff9d1c426b5adba9149d1383",
    ),
    "LGPL-3.0": ("148b473852f0e3b14ba500ebbd2e8f9c",),
    "MPL-1.1": ("6e365c275f8417ffb1970ee046fbde33",),
    "MPL-2.0": ("14f2e59a3bb121c9ccc71e99691b31b1",),
}


def canonical(text: str) -> str:
    """As ``canonical_column``, for the known texts."""
    out = re.sub(COPYRIGHT, "", text.lower(), flags=re.M)
    for old, new in SPELLINGS:
        out = re.sub(old, new.replace("$", "\\"), out)
    return re.sub(OTHER, " ", out).strip(" ")


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?md)" + COPYRIGHT), F.lit(""))
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new)
    return F.trim(F.regexp_replace(out, OTHER, " "))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): whole texts, with and without a title; paragraphs of them that no other licence has; and every
    notice, a lead before a name."""
    out, held = [], {}
    for name, (text, titles) in TEXTS.items():
        out += [(name, text), *((name, f"{title}\n\n{text}") for title in titles)]
        for part in re.split(BLANK, text):
            held.setdefault(canonical(part), (part, set()))[1].add(name)
    out += [(min(names), part) for key, (part, names) in held.items() if len(names) == 1 and len(key.split()) >= LEAST_WORDS and re.search(ANCHOR, part)]
    return out + [(k, f"{lead} {name}") for k, names in NAMES.items() for name in names for lead in LEADS]


def known_digests(texts: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, licence), one licence a digest: the first in order of name. Without ``texts``, long licences are among them."""
    out = {d: name for name, digests in LONG_TEXTS.items() for d in digests} if texts is None else {}
    for name, text in sorted(known_texts() if texts is None else texts):
        if not re.search(ANCHOR, text):
            raise ValueError(f"a text of {name} holds no anchor word")
        out.setdefault(hashlib.md5(canonical(text).encode()).hexdigest(), name)
    return sorted(out.items())


def license_scan(spark: SparkSession, docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest (of the whole canonical text), text_license (null: none), n_notices (lines found), n_blocks (blocks of
    several lines found), licenses (of lines and blocks, sorted, comma-joined)."""
    known = spark.createDataFrame(known_digests(texts), "digest string, license string")
    source = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(BREAK), F.lit("\n")).alias("text"))
    whole = source.select("doc_id", F.md5(canonical_column(F.col("text"))).alias("digest"))
    null = F.lit(None).cast("string")
    whole = whole.join(F.broadcast(known), "digest", "left").select("doc_id", F.col("digest").alias("text_digest"), F.col("license").alias("text_license"), null.alias("found"), F.lit(0).alias("block"))  # known: under a thousand rows
    anchored = source.filter(F.col("text").rlike(ANCHOR))
    lines = anchored.select("doc_id", F.lit(0).alias("block"), F.explode(F.split("text", "\n")).alias("part"))
    blocks = anchored.select("doc_id", F.lit(1).alias("block"), F.explode(F.split("text", BLANK)).alias("part")).filter(F.trim("part", F.lit("\n")).contains("\n"))
    parts = lines.union(blocks).filter(F.col("part").rlike(ANCHOR)).select("doc_id", "block", F.md5(canonical_column(F.col("part"))).alias("digest"))
    parts = parts.join(F.broadcast(known), "digest").select("doc_id", null.alias("text_digest"), null.alias("text_license"), F.col("license").alias("found"), "block")
    per_kind = whole.unionByName(parts).groupBy("doc_id", "found").agg(F.min("text_digest").alias("text_digest"), F.min("text_license").alias("text_license"), F.sum(F.when(F.col("found").isNotNull(), 1 - F.col("block")).otherwise(0)).alias("n"), F.sum("block").alias("b"))
    return per_kind.groupBy("doc_id").agg(
        F.min("text_digest").alias("text_digest"),
        F.min("text_license").alias("text_license"),
        F.sum("n").alias("n_notices"),
        F.sum("b").alias("n_blocks"),
        F.array_join(F.array_sort(F.collect_set("found")), ",").alias("licenses"),
    )


def oracle() -> str:
    def sql_canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), '(?m){COPYRIGHT}', '', 'g')"
        for old, new in SPELLINGS:
            out = f"regexp_replace({out}, '{old}', '{new.replace('$', chr(92))}', 'g')"
        return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"

    known = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""
    WITH known(digest, license) AS (VALUES {known}),
    docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents),
    whole AS (SELECT doc_id, md5({sql_canonical('text')}) AS digest FROM docs),
    parts AS (SELECT doc_id, 0 AS block, unnest(string_split(text, chr(10))) AS part FROM docs
              UNION ALL SELECT doc_id, 1, part FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS part FROM docs) WHERE contains(trim(part, chr(10)), chr(10))),
    hits AS (SELECT doc_id, block, license FROM (SELECT doc_id, block, md5({sql_canonical('part')}) AS digest FROM parts) JOIN known USING (digest)),
    found AS (SELECT doc_id, sum(1 - block) AS n, sum(block) AS b, string_agg(DISTINCT license, ',' ORDER BY license) AS l FROM hits GROUP BY doc_id)
    SELECT w.doc_id, min(w.digest) AS text_digest, min(k.license) AS text_license,
           CAST(coalesce(min(f.n), 0) AS BIGINT) AS n_notices, CAST(coalesce(min(f.b), 0) AS BIGINT) AS n_blocks, coalesce(min(f.l), '') AS licenses
    FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM w.doc_id
    GROUP BY w.doc_id"""
