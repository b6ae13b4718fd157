"""Licence scans by canonical digest: entire texts, and entire lines of texts, looked up among the
digests of known licences.  DataFrame functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Notices that name a licence, and short licences in full.
SHORT = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice "
        "may not be removed or altered from any source distribution.",
    ),
)
#: Published texts in full, in files named after the licence (and a variant of it, behind ~).
TEXTS = Path(__file__).with_name("licence_texts")
#: Headings that a licence is published with, or without.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License", "The BSD License"),
    "Artistic-1.0-Perl": ('The "Artistic License"', "The Artistic License", "Artistic License", "The Artistic License 1.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License", "The BSD License"),
}
_APPENDIX = re.compile(r"^[ \t]*(?:APPENDIX: |Appendix: )?How to [Aa]pply ", re.MULTILINE)


def _spellings(licence: str, text: str) -> set[tuple[str, str]]:
    """The text as it stands, without the appendix that tells how to apply it, and under each heading or none."""
    found = {text}
    if appendix := _APPENDIX.search(text):
        found.add(text[: appendix.start()])
    if "\n" in text and licence in HEADINGS:
        first, rest = text.split("\n", 1)
        body = rest if first in HEADINGS[licence] else text
        found |= {body, *(f"{heading}\n{body}" for heading in HEADINGS[licence])}
    return {(licence, t) for t in found}


_PUBLISHED = tuple((path.stem.split("~")[0], path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt")))
KNOWN = tuple(sorted(set().union(*(_spellings(licence, text) for licence, text in SHORT + _PUBLISHED))))
#: Spellings taken as one, as parts of words.
SPELLINGS = (("licenc", "licens"), ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("https", "http"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins, behind comment marks, with a copyright sign or word and a year, with the word and the sign, or with the sign
#: ©; one that begins with the word and ends with a year; and the reservation of all rights.
COPYRIGHT = (
    r"^[ \t\r*#/;-]*(?:copyright|\(c\)|©)[^a-z0-9]*(?:(?:copyright|c)[^a-z0-9]+)?[0-9]{4}|^[ \t\r*#/;-]*all rights reserved[ \t\r.]*$"
    r"|^[ \t\r*#/;-]*(?:copyright[ \t]*(?:\(c\)|©)|©)|^[ \t\r*#/;-]*copyright[ \t:].*[^a-z0-9](?:19|20)[0-9]{2}[ \t\r.,]*$"
)
#: ASCII characters other than letters and digits, and typographic punctuation.
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F ‐-‧«»]+"


#: What follows the first sentence of a copyright line, which names its holder.
HOLDER = r"^[^.]*\.[ \t]+"
#: Line ends: CR LF, LF or CR.
LINE_ENDS = r"\r\n|\n|\r"


def canonical_words(text: str) -> str:
    """The canonical form of one line, as ``canonical_lines`` makes it."""
    line = re.sub(PUNCTUATION, " ", text.translate(str.maketrans(_UPPER, _LOWER)))
    for old, new in SPELLINGS:
        line = line.replace(old, new)
    return line.strip(" ")


def notices_of(known: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Known texts of one line: notices, which may also stand behind the holder in a copyright line."""
    return tuple(sorted({canonical_words(text) for _, text in known if "\n" not in text and not re.search(COPYRIGHT, text.lower())}))


NOTICES = notices_of(KNOWN)


def canonical_lines(text: Column, notices: tuple[str, ...] = NOTICES) -> Column:
    """The text's lines in canonical form, those left empty dropped; of a copyright line a known notice
    behind its first sentence is left, or nothing."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)

    def canonical(line: Column) -> Column:
        line = F.regexp_replace(line, PUNCTUATION, " ")
        for old, new in SPELLINGS:
            line = F.replace(line, F.lit(old), F.lit(new))
        return F.trim(line)

    def kept(line: Column) -> Column:
        rest = canonical(F.regexp_replace(line, HOLDER, ""))
        return F.when(line.rlike(COPYRIGHT), F.when(rest.isin(list(notices)), rest).otherwise("")).otherwise(canonical(line))

    return F.filter(F.transform(F.split(lower, LINE_ENDS), kept), lambda line: line != "")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, licence) of known licences; of equal texts the smallest name counts."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    whole = F.sha2(F.array_join(canonical_lines(F.col("text"), notices_of(known)), " "), 256)
    return rows.select(whole.alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, licence, notices) of each row: the digest of the entire canonical text, the
    licence with that digest (null: none), and an array of (line number, licence) of the entire lines
    that are known, by canonical line number from 1; a notice broken over two lines has the first one's
    number, and one behind the holder in a copyright line counts as a line.

    A null or empty text has the digest of the empty text and no licence; null ids are kept; repeated
    rows give repeated results; an empty table gives none.  Only the two named columns are read.
    ``known`` is a fixed list, so its digests are joined by broadcast: no text is shuffled, only the
    lines that were found and one narrow row per document.
    """
    spark = docs.sparkSession
    digests, notices = F.broadcast(known_digests(spark, known)), notices_of(known)
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), canonical_lines(F.col(text_col), notices).alias("_lines")
    )
    longest = max(map(len, notices), default=0)
    wrapped = F.transform("_lines", lambda line, i: F.concat_ws(" ", line, F.get("_lines", i + 1)))
    two = lambda x: F.when((F.length(x["two"]) <= longest) & (x["two"] != x["one"]), F.array(x["one"], x["two"])).otherwise(F.array(x["one"]))
    tried = F.transform(F.arrays_zip(F.col("_lines").alias("one"), wrapped.alias("two")), two)
    lines = rows.select("id", "_text", F.posexplode(tried).alias("_no", "_tried")).select("id", "_text", "_no", F.explode("_tried").alias("_line"))
    found = lines.select("id", "_text", (F.col("_no") + 1).cast("bigint").alias("line"), F.sha2("_line", 256).alias("digest")).join(digests, "digest")
    # rows repeated with the same id and text find the same lines
    by_row = found.groupBy("id", "_text").agg(F.sort_array(F.collect_set(F.struct("line", "licence"))).alias("notices"))
    whole = rows.select("id", "_text", F.sha2(F.array_join("_lines", " "), 256).alias("digest")).join(digests, "digest", "left").alias("w")
    same = F.col("w.id").eqNullSafe(F.col("n.id")) & (F.col("w._text") == F.col("n._text"))
    none = F.array().cast("array<struct<line:bigint,licence:string>>")
    return whole.join(by_row.alias("n"), same, "left").select(
        F.col("w.id").alias("id"), F.col("w.digest").alias("text_digest"), F.col("w.licence").alias("licence"), F.coalesce(F.col("n.notices"), none).alias("notices")
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def canonical_lines_sql(text: str) -> str:
    """The same lines in DuckDB."""

    def canonical(line: str) -> str:
        line = f"regexp_replace({line}, {_sql_text(PUNCTUATION)}, ' ', 'g')"
        for old, new in SPELLINGS:
            line = f"replace({line}, '{old}', '{new}')"
        return f"trim({line}, ' ')"

    lower = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    rest = canonical(f"regexp_replace(l, {_sql_text(HOLDER)}, '')")
    notices = ", ".join(map(_sql_text, NOTICES))
    kept = f"CASE WHEN regexp_matches(l, {_sql_text(COPYRIGHT)}) THEN CASE WHEN {rest} IN ({notices}) THEN {rest} ELSE '' END ELSE {canonical('l')} END"
    return f"list_filter(list_transform(regexp_split_to_array({lower}, {_sql_text(LINE_ENDS)}), lambda l: {kept}), lambda l: l <> '')"


def scan_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    values = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known)
    return f"""
WITH known AS (
  SELECT sha256(array_to_string({canonical_lines_sql("text")}, ' ')) AS digest, min(licence) AS licence
  FROM (VALUES {values}) AS t(licence, text) GROUP BY 1),
rows AS (SELECT doc_id, row_number() OVER () AS n, {canonical_lines_sql("text")} AS lines FROM documents),
found AS (
  SELECT n, string_agg(line || ':' || licence, ',' ORDER BY line, licence) AS notices, count(*) AS n_notices
  FROM (
    SELECT DISTINCT n, line, licence FROM (
      SELECT n, line, unnest(CASE WHEN length(concat_ws(' ', l, following)) <= {max(map(len, notices_of(known)), default=0)} THEN [l, concat_ws(' ', l, following)] ELSE [l] END) AS tried
      FROM (SELECT n, unnest(lines) AS l, unnest(list_append(lines[2:], NULL)) AS following, generate_subscripts(lines, 1) AS line FROM rows))
    JOIN known ON digest = sha256(tried)) GROUP BY n)
SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM rows LEFT JOIN known ON digest = sha256(array_to_string(lines, ' ')) LEFT JOIN found USING (n)
"""
