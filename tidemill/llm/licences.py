"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: letters in lower case; copyright statements left out, whole
lines or up to the terms that follow on their line; equivalent spellings made one; every run of other
characters than letters and digits made one space; trimmed. The SHA-256 of the
canonical form of the entire text is joined to the digests of known licences, made
by the same functions from their texts. ``LIMIT`` bounds the known licences, and
that bound is checked, so their table is broadcast.

Unless others are given, the known licences are ``KNOWN`` and the files of
``licence_texts``, in the forms in which whole licences are found (``forms``): with and
without the title, the appendix on how to apply them, and a filled-in copyright line.

Every document gets a row. A text that merely contains a licence does not match.

Defined results: a null text counts as empty; an empty canonical form matches
nothing; null or repeated ids are kept; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

import functools
import importlib.resources
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 10_000

# Texts of public licences, and short notices, to take digests from.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n"
        + _AS_IS
        + "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
}
#: Titles above texts that have none of their own.
_BSD_TITLES = ("BSD License", "The BSD License")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": (*_BSD_TITLES, "BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": (*_BSD_TITLES, "BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib License (zlib)", "zlib/libpng License", "The zlib/libpng License"),
}
#: Paragraphs of title at the head of a file of ``licence_texts``, if not one.
TITLE_PARAGRAPHS = {"BSD-3-Clause": 0, "CC0-1.0": 2}
#: The line after which a text only says how to apply it, and a copyright line to fill in.
TERMS_END = "END OF TERMS AND CONDITIONS"
TO_FILL_IN = "Copyright [yyyy] [name of copyright owner]"
#: Spellings that count as the same.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("behaviour", "behavior"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("redistribute and use", "redistribution and use"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
)
#: How the terms begin that may follow a copyright statement on its line.
TERMS = (
    "everyone is permitted", "licensed under", "permission is hereby granted", "permission to use", "redistribution and use", "redistribute and use",
    "released under", "this program is free software", "this software is provided", "this work is licensed",
)
_TERMS = "|".join(TERMS)
#: Copyright statements. One with a sign or a year goes up to the terms or the end of its line; one with a
#: name only must be a paragraph of its own or begin one whose terms follow on its line.
STATEMENT = rf"(?m)^[^a-z0-9\n©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{{4}}|<year>|\[year\])|\(c\)[ \t]*(?:copyright|[0-9]{{4}})|©)[^\n]*?({_TERMS}|\n|\z)"
RESERVED = r"(?m)^[^a-z0-9\n©]*all rights reserved[^a-z0-9\n]*$"
NAMED = rf"(?:\A|\n[ \t\r]*\n)[^a-z0-9\n©]*copyright[ \t][^\n]*?({_TERMS}|\n[ \t\r]*\n|\n?\z)"
#: Fixed value: a run of separators.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x{A0}\x{2000}-\x{206F}]+"


def canonical(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    marked = text.contains("copyright") | text.contains("(c)") | text.contains("©") | text.contains("all rights reserved")
    plain = F.regexp_replace(F.regexp_replace(text, STATEMENT, "$1"), RESERVED, "")
    text = F.when(marked, F.regexp_replace(plain, NAMED, "\n\n$1")).otherwise(text)
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def forms(name: str, text: str, title_paragraphs: int) -> set[str]:
    """A licence's text as whole documents have it."""
    found = {text, text.replace(TO_FILL_IN, "")}
    if TERMS_END in text:
        head = text[: text.index(TERMS_END)]
        found |= {head, head + TERMS_END}
    for whole in list(found):
        paragraphs = re.split(r"\n\s*\n", whole.strip())
        found |= {"\n\n".join(paragraphs[k + 1 :]) for k in range(title_paragraphs)}
    found |= {f"{title}\n\n{text}" for title in TITLES.get(name, ())}
    # Newer copies of one text give its links with https.
    return found | {x.replace("http://", "https://") for x in found} | {x.replace("https://", "http://") for x in found}


@functools.cache
def included() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every form of the texts that this module has."""
    rows = {(name, form) for name, text in KNOWN.items() for form in forms(name, text, 0)}
    for file in importlib.resources.files(__package__).joinpath("licence_texts").iterdir():
        name = file.name.removesuffix(".txt")
        rows |= {(name, form) for form in forms(name, file.read_text(encoding="utf-8"), TITLE_PARAGRAPHS.get(name, 1))}
    return tuple(sorted(rows))


def known(spark: SparkSession, texts: dict[str, str] | tuple[tuple[str, str], ...]) -> DataFrame:
    if len(texts) > LIMIT:
        raise ValueError(f"{len(texts)} known licences; at most {LIMIT} are broadcast")
    rows = spark.createDataFrame(list(texts.items() if isinstance(texts, dict) else texts), "licence string, licence_text string")
    digest = F.sha2(canonical(F.col("licence_text")).cast("binary"), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_chars, digest, licence (null: none) of every row of ``docs``."""
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    digests = form.select("doc_id", F.char_length("form").cast("long").alias("canonical_chars"), F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    found = F.when(F.col("canonical_chars") > 0, F.col("licence")).alias("licence")
    return digests.join(F.broadcast(known(docs.sparkSession, included() if texts is None else texts)), "digest", "left").select("doc_id", "canonical_chars", "digest", found)


def op10_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_form(text: str) -> str:
    form = f"lower(coalesce({text}, ''))"
    for pattern, rest in ((STATEMENT, "'\\1'"), (RESERVED, "''"), (NAMED, "chr(10) || chr(10) || '\\1'")):
        form = f"regexp_replace({form}, '{pattern}', {rest}, 'g')"
    for other, one in SPELLINGS:
        form = f"replace({form}, '{other}', '{one}')"
    return f"trim(regexp_replace({form}, '{SEPARATORS}', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
SQL = f"""
WITH known AS (
  SELECT sha256({_sql_form("t")}) AS digest, min(licence) AS licence FROM (VALUES {_VALUES}) v(licence, t) GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents)
SELECT doc_id, CAST(length(form) AS BIGINT) AS canonical_chars, sha256(form) AS digest,
  CASE WHEN form <> '' THEN licence END AS licence
FROM forms LEFT JOIN known ON sha256(form) = known.digest
"""
