"""Licence scan by canonical digests: whole texts, normalised, looked up among the digests of known licences.

Both sides are normalised alike: lower case, copyright lines and comment marks taken out, equivalent spellings and endings made one,
all but letters and digits turned into single spaces. The SHA-256 digest of what is left is hash-joined to the digests of the known
licences, so no text moves; each distinct digest that licences share is answered by the first licence name.

Null texts and texts with nothing left have no digest and no licence. Rows are answered each by itself, repeated ones too.
Whole texts are in the folder licenses, in the forms in which they are published (titles, "All rights reserved", numbers or bullets). An empty table gives an empty result; of the documents only the two named columns are looked at. DataFrame functions only.
"""

from __future__ import annotations

import re
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare

#: Spellings that licence matching guidelines treat as the same, after lower-casing and punctuation is gone.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("artefact", "artifact"),
    ("calibre", "caliber"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("programmes", "programs"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Endings that are spelt in two ways, as a word's pattern and what it becomes. Words that have only one spelling change alike on both sides.
ENDINGS = (
    (" ([a-z]{2,})is(e|ed|es|er|ing|ation|ations) ", " \\1iz\\2 "),
    (" ([a-z]{3,})our(s|ed|ing|able|ably|ite)? ", " \\1or\\2 "),
    (" (cancel|label|level|model|signal|travel)l(ed|ing) ", " \\1\\2 "),
    (" (ana|cata|dia)logue ", " \\1log "),
    (" ((?:sub)?lic|def|off)ence(d|s)? ", " \\1ense\\2 "),
)

#: Short texts of known licences and the notices that stand for longer ones.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Fair", "Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument. DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY."),
)

#: Titles that stand above a licence whose own text has none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Fair": ("Fair License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def _forms(name: str, text: str) -> set[tuple[str, str]]:
    """(name, text) of the ways in which a whole licence is published, apart from what normalised() makes one."""
    found = {(name, text)}
    if name == "Apache-2.0":  # the appendix may be left out, or its copyright line filled in
        body = text[: text.index("END OF TERMS AND CONDITIONS")]
        found |= {(name, body), (name, body + "END OF TERMS AND CONDITIONS"), (name, text.replace("Copyright [yyyy] [name of copyright owner]", ""))}
    if name.startswith(("GPL-", "LGPL-")):  # the foundation has moved, and writes its street in two ways
        old = r"51 Franklin St(?:reet)?, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"
        places = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
        found |= {(name, re.sub(old, place, text)) for place in places}
    if name == "BSD-3-Clause":
        third = re.search(r"3\. Neither.*?permission\.", text, re.S).group()
        whole = [(name, text), (name, text.replace("copyright holder nor", "University nor")), (name, text.replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR").replace("copyright holder nor", "University nor"))]
        whole.append(("BSD-2-Clause", text.replace(third, "")))
        found = {(n, re.sub(r"(?m)^[123]\. ", mark, t)) for n, t in whole for mark in ("", "* ")} | set(whole)
    if name in ("BSD-3-Clause", "MIT"):
        found |= {(n, t.replace(*swap)) for n, t in found for swap in (("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), ("HOLDERS AND", "HOLDER AND"))}
    for n, t in list(found):
        tops = product(("", *TITLES.get(n, ())), ("", "All rights reserved.")) if n in TITLES else ()
        found |= {(n, f"{title}\n{reserved}\n{t}".strip()) for title, reserved in tops}
    return found


def _whole_licenses() -> tuple[tuple[str, str], ...]:
    """Licences of the folder licenses and those above that are whole, in all their forms."""
    texts = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")]
    return tuple(sorted(set().union(*(_forms(*x) for x in [*texts, *KNOWN[4:]])) - set(KNOWN)))


KNOWN = KNOWN + _whole_licenses()

_COPYRIGHT_LINE = r"(?im)^[\s/*#;.%-]*(?:\(c\)|©|copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}))[^\n]*$"


def normalised(text: Column) -> Column:
    plain = F.regexp_replace(text, _COPYRIGHT_LINE, " ")
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))  # words share no space
    for ending, kept in ENDINGS:
        plain = F.regexp_replace(plain, ending, kept.replace("\\", "$"))
    for spelling, kept in EQUIVALENT:
        plain = F.replace(plain, F.lit(f" {spelling} ".replace(" ", "  ")[1:-1]), F.lit(f" {kept} "))
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    plain = normalised(text)
    return F.when(plain != "", F.sha2(plain, 256))


def known_licenses(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(texts), "license_id string, text string")


def scan_licenses(documents: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_digest and license_id (null: none known) of every row; known has license_id and text, and its digests are joined as Spark's size estimate allows."""
    prepare(documents.sparkSession)
    digests = known.select("license_id", digest(F.col("text").cast("string")).alias("text_digest")).filter("text_digest IS NOT NULL").groupBy("text_digest").agg(F.min("license_id").alias("license_id"))
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`").cast("string")).alias("text_digest"))
    return rows.join(digests, "text_digest", "left").select("doc_id", "text_digest", "license_id")
