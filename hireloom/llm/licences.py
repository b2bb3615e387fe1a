"""Licence texts and notices, found by the digest of their canonical form.

A text is brought to a canonical form in which copies of one licence agree:
letters are lower-cased, lines that state a copyright go, punctuation and white
space become single spaces, and words with several accepted spellings take one
of them. The digest of the whole canonical text is joined with those of the
known licences. The same is done for each line, for the notices by which a
document names its licence. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)

#: Public licence texts, without titles and copyright lines.
LICENCES = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n" + _WARRANTY,
    ),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n" + _BSD_END,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
        "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]
#: Digests of the canonical forms of longer licences, as they are published.
DIGESTS = [
    ("Apache-2.0", "b70b775be059fa7d88c23d2138accf3f39fb8edb07d5499466395f2ec8a373ed"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "3a9eae4a11504ad2232ac014586792cc731b7ac8701f44b15724316fb279f6df"),
    ("GFDL-1.2", "0fbd524a2f5669d7b07d756075b00eb2f101ad0e5c241321a4bf7acab5554cc3"),
    ("GFDL-1.3", "65f6fe3c32c51dedb8e3e71d567b294bfff5ccdbce4d9a5a0904b56399903cd4"),
    ("GPL-1.0", "44b35cc69c1f864dba217d3e35766425d272b2d229a6cde2e0cdcc67803bddf8"),
    ("GPL-2.0", "9091b3188640d6723b461e8e012a229d5f77219e2083a669135a30d2b1b4297f"),
    ("GPL-3.0", "9b921f4ca5873a2147789a6e1401dd7a4e7407913f023eb3a58bf8f3e5802b8b"),
    ("LGPL-2.0", "2a6ac921e4c62568a2b266e6164cb6819d2a06f7007ad9e187ada8d4770702d2"),
    ("LGPL-2.1", "0ca5c17aaa8deceea63b6afae195c7b8e4c2457d104e2a35bb62009f9d4d603b"),
    ("LGPL-3.0", "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0"),
    ("MPL-1.1", "34b9ae46a3a80dab95fed851138a47842908f8a598a19d4158955023a3eb3ab7"),
    ("MPL-2.0", "16bf53094aa71cdf0e28cf166f759a4fde1cc1e3cae6c443ef8e6bf4157561f4"),
]
#: Notices by which a text names its licence, one line each.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
]
#: Lines that state a copyright, with a sign or a year so that a wrapped sentence is none; marks of list items; titles
#: (on the spaced text); and spellings that count as one (pattern on the spaced text, spelling taken).
COPYRIGHT_LINE = r"(^|\n)[ \t]*((portions )?copyright[ \t:]*(\(c\)|©|[0-9]{4}|<|\[)|(\(c\)|©)[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
LIST_MARK = r"(^|[ \t\n])\(?([0-9]{1,2}[.)]|[a-z][.)])[ \t\n]+"
_NAMES = "mit|x11|expat|isc|zlib|bsd|new bsd|modified bsd|revised bsd|simplified bsd|bsd (zero|0|2|3) clause|(zero|0|2|3) clause bsd"
TITLE = rf"^(the )?({_NAMES}) license( ({_NAMES}|0bsd)( license)?)?( |$)"
ODD_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPELLINGS = [
    (r"licenc(e|es|ed|ing)\b", r"licens\1"),
    (r"\bsub (licens)", r"sub\1"),
    (r"\b(author|organ|recogn|util)is(e|es|ed|ing|ation|ations)\b", r"\1iz\2"),
    (r"\b(fav|hon|lab)our", r"\1or"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(merchant)ibility\b", r"\1ability"),
    (r"\bnon (infringement|commercial)", r"non\1"),
    (r"\bcopyright (owner)(s?)\b", r"copyright holder\2"),
]
# End of the fixed values.
#: Known texts travel to every task, so their number is bounded.
MOST_KNOWN = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The form in which copies of one licence agree; null for null."""
    x = F.translate(text, _UPPER, _LOWER)
    x = F.regexp_replace(x, COPYRIGHT_LINE, r"$1")
    x = F.regexp_replace(x, LIST_MARK, r"$1")
    x = F.trim(F.regexp_replace(x, ODD_SIGNS, " "))
    for pattern, taken in SPELLINGS:
        x = F.regexp_replace(x, pattern, taken.replace("\\", "$"))
    return F.regexp_replace(x, TITLE, "")


def canonical_sql(text: str) -> str:
    """The same as a DuckDB expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    x = f"regexp_replace({x}, {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
    x = f"regexp_replace({x}, {quote(LIST_MARK)}, '\\1', 'g')"
    x = f"trim(regexp_replace({x}, {quote(ODD_SIGNS)}, ' ', 'g'))"
    for pattern, taken in SPELLINGS:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(taken)}, 'g')"
    return f"regexp_replace({x}, {quote(TITLE)}, '')"


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``licence_id`` and ``digest`` of known texts, a table of as many rows as the list."""
    rows = spark.createDataFrame(known, "licence_id string, known string")
    return rows.groupBy(F.sha2(canonical(F.col("known")), 256).alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def licence_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: list[tuple[str, str]] = LICENCES, digests: list[tuple[str, str]] = DIGESTS, notices: list[tuple[str, str]] = NOTICES, notice_pattern: str = "(?i)licen[cs]e"
) -> DataFrame:
    """One row per input row: ``id_col``, ``digest``, ``licence_id`` and ``notices``.

    ``digest`` is that of the whole canonical text, ``licence_id`` the known
    licence of that digest or null, ``notices`` the sorted distinct licences
    that lines of the text name; lines without ``notice_pattern`` hold none. A null text counts as empty; an empty text has
    the digest of the empty string and no licence. Null and repeated ids are
    kept. An empty table gives no rows. Other columns are ignored. Known texts
    (``licences``) and digests of known texts (``digests``) of one digest count
    as the first of their names. Titles above a text, list marks, line wraps
    and copyright statements make no difference; very long texts are compared
    whole.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Both sides of the join with known texts: the list of known texts is a constant of the program.
    if len(licences) + len(digests) + len(notices) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    more = spark.createDataFrame(digests, "licence_id string, digest string")
    known = known_digests(spark, licences).unionByName(more).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    known = F.broadcast(known)
    names = F.create_map(*[F.lit(x) for row in known_digests(spark, notices).collect() for x in row])
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(notice_pattern))
    named = F.filter(F.transform(lines, lambda s: F.element_at(names, F.sha2(canonical(s), 256))), lambda n: n.isNotNull())
    return (
        base.select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.array_sort(F.array_distinct(named)).alias("notices"))
        .join(known, "digest", "left")
        .select(F.col("id").alias(id_col), "digest", "licence_id", "notices")
    )
