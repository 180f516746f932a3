"""License scans by canonical digest lookup, with DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines dropped, every run of
characters other than letters and digits made one space, equivalent spellings made one.
Whole texts whose canonical digest is that of a known licence get its name. Known are the
texts of ``LICENSES`` and ``MORE``, the whole licences in ``license_texts`` and a table that
the caller gives. Their digests are broadcast while they are at most MAX_BROADCAST; a larger
table is joined by digest. A text given under several names has the first of them in order.

Equivalent spellings replace one word by one word, so a text whose number of words is
none of the known ones can match nothing, and the costly replacement is left out for it;
its digest is then null.

Defined cases: null and blank texts have no digest and no licence; repeated rows each get
theirs; an empty table gives an empty table; input columns named license_id or
license_digest are replaced.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.shared import kept, spare, without

#: Known texts up to which their digests are broadcast.
MAX_BROADCAST = 20_000

_PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Known licence texts and notices, by name. A licence can have several texts.
LICENSES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("ISC", _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("ISC", "ISC License\n\n" + _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", _PERMISSION + "." + _ISC_TAIL),
    ("0BSD", "BSD Zero Clause License\n\n" + _PERMISSION + "." + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org/>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)

#: Spellings that count as one, each a single word.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("holders", "holder"),
    ("https", "http"),
)

#: Known texts and notices beyond those that the SQL knows.
MORE: tuple[tuple[str, str], ...] = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
)

#: Where the terms of a whole licence end and advice to those who apply it begins; texts come with and without it.
ADVICE = ("   APPENDIX: How to apply", "How to Apply These Terms", "Appendix: How to Apply", "ADDENDUM: How to use")

_W = r"[\x20\x09\x0B\x0C\r]"
_YEAR = r"(?:19|20)\d\d\b"
#: A line that only states a copyright.
COPYRIGHT_LINE = (
    rf"(?im)^{_W}*(?:copyright{_W}*:?{_W}*(?:\(c\)|©|&copy;|{_YEAR}|by\b)[^\n]*|copyright\b(?!{_W}+(?:treaty|law|notice|holder|owner)s?\b)[^\n]*{_YEAR}[\x20\x09\r.]*|©[^\n]*|\(c\){_W}*(?:copyright\b|{_YEAR}|by\b)[^\n]*|\(c\)[^\n]*{_YEAR}[\x20\x09\r.]*"
    rf"|(?<=\A{_W}{{0,40}}|\n{_W}{{0,40}}\n{_W}{{0,40}})copyright\b[^\n]*(?=\n{_W}*(?:\n|all rights reserved|copyright\b)|\n?\z)|all rights reserved[\x20\x09\x0B\x0C\r.!]*)$"
)
#: The pattern of the SQL, which drops every line that begins so.
SQL_COPYRIGHT_LINE = r"(?im)^[\x20\x09\x0B\x0C\r]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the whole licences, with and without the advice behind their terms."""
    out = []
    for file in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        ends = [at for a in ADVICE if (at := text.rfind(a)) > 0]
        forms = [text, *[text[:at] for at in ends]]
        forms += [re.sub(r"(?i)all rights reserved\.", "", t) for t in forms if re.search(r"(?i)all rights reserved\.", t)]  # a wrap can put it on a line of its own
        out += [(file.stem, t) for t in forms]
    return out


def plain(text: Column) -> Column:
    """Lower-case words with single spaces, without copyright lines."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")), r"[^\p{L}\p{N}]+", " "))


def spelled(words: Column) -> Column:
    """Words with equivalent spellings made one."""
    known = F.create_map(*[F.lit(x) for pair in EQUIVALENT for x in pair])
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def known_digests(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """(license_id, license_digest, words), a row for each known text; ``table`` has license_id and text."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in [*LICENSES, *MORE, *whole_texts()]])
    known = spark.range(1).select(F.inline(rows))
    if table is not None:
        known = known.unionByName(table.select(F.col("license_id").cast("string"), F.col("text").cast("string")).where("license_id IS NOT NULL"))
    known = known.withColumn("plain", plain(F.col("text"))).where("plain <> ''")
    known = known.select("license_id", F.md5(spelled(F.col("plain"))).alias("license_digest"), F.size(F.split("plain", " ")).alias("words"))
    return known.groupBy("license_digest", "words").agg(F.min("license_id").alias("license_id"))


def scan(spark: SparkSession, docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``docs`` with license_digest and license_id, null where the whole text is no known licence; ``table`` (license_id, text) adds to the known."""
    known, _ = kept(spark, known_digests(spark, table), "known-licenses")
    few = known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    lengths = spark.range(1).select(F.explode(F.array(*[F.lit(text) for _, text in LICENSES])).alias("t")).select(F.size(F.split(plain(F.col("t")), " ")).alias("words"))
    shown = sorted({r["words"] for r in lengths.collect()})  # a row for each text of LICENSES
    docs = without(docs, ["license_digest", "license_id"])
    names = [f"`{c}`" for c in docs.columns]
    form, listed = spare(docs, "plain", "shown")
    docs = docs.withColumn(form, plain(F.col("text")))
    words = F.length(form) - F.length(F.translate(form, " ", "")) + 1
    docs = docs.withColumn(listed, words.isin(shown))
    sought = words.isin(sorted({*shown, *(r["words"] for r in known.select("words").distinct().collect())})) if few else F.lit(True)
    docs = docs.withColumn("license_digest", F.when((F.col(form) != "") & sought, F.md5(spelled(F.col(form))))).drop(form)
    known = known.drop("words")
    joined = docs.join(F.broadcast(known) if few else known, "license_digest", "left")
    return joined.select(*names, F.when(F.col(listed) | F.col("license_id").isNotNull(), F.col("license_digest")).alias("license_digest"), "license_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "license_digest", "license_id")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in LICENSES)
    known = ", ".join(f"{quote(a)}: {quote(b)}" for a, b in EQUIVALENT)
    made = lambda c: f"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '{SQL_COPYRIGHT_LINE}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    digest = f"md5(array_to_string(list_transform(string_split(p, ' '), lambda w: coalesce(map {{{known}}}[w], w)), ' '))"
    return f"""
WITH known AS (
  SELECT DISTINCT license_id, {digest} AS license_digest, len(string_split(p, ' ')) AS n FROM (SELECT license_id, {made("t")} AS p FROM (VALUES {texts}) x(license_id, t))
), made AS (
  SELECT doc_id, {made("text")} AS p FROM documents
), digests AS (
  SELECT doc_id, CASE WHEN p <> '' AND len(string_split(p, ' ')) IN (SELECT n FROM known) THEN {digest} END AS license_digest FROM made
)
SELECT d.doc_id, d.license_digest, k.license_id FROM digests d LEFT JOIN known k ON d.license_digest = k.license_digest
"""


ORACLE_SQL = _sql()
