"""Licence texts found by the digest of their canonical form.

Letter case, punctuation, white space, copyright lines and equivalent spellings do not count. A
text, or one line of it, is a licence if the digest of its canonical form is in the table of known
licences; nothing is matched in part.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that mean the same in licence texts, as in public matching guidelines. They
# are compared without punctuation, so a hyphen stands as a space.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "sub license": "sublicense", "organisation": "organization", "favour": "favor", "honour": "honor",
    "whilst": "while", "wilful": "willful", "merchantibility": "merchantability",
    "non infringement": "noninfringement", "per cent": "percent", "https": "http",
}

# Known licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
KNOWN += [("Apache-2.0", _APACHE_HEADER), ("MPL-2.0", _MPL_HEADER)]
#: Whole texts, one file each, by the licence's name.
KNOWN += [(file.stem, file.read_text("utf-8")) for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
KNOWN += [(name, f"{title}\n\n{text}") for name, title in (
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"))
    for known, text in KNOWN if known == name]
KNOWN += [(name, f"SPDX-License-Identifier: {name}") for name in (
    "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "Zlib")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The form of a text that is digested; blank if nothing but copyright lines is in it."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    out = F.concat(F.lit(" "), F.btrim(out, F.lit(" ")), F.lit(" "))
    for word, same in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest``, ``license``: one row per digest, the smaller name where two texts have one."""
    rows = spark.createDataFrame(texts if texts is not None else KNOWN, "license STRING, text STRING")
    return rows.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(
        F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``text_sha256`` (of the canonical text), ``license``, ``line_licenses``, ``n_lines``.

    ``license`` is that of the entire text or NULL; ``line_licenses`` are those of single lines,
    sorted, comma-joined, and ``n_lines`` how many lines there are of them. A NULL or empty text
    has the digest of the empty text and no licence. Repeated rows are repeated in the result.
    """
    text = F.coalesce("text", F.lit(""))
    units = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.concat(
        F.array(text), F.split(text, "\n"))).alias("pos", "unit"))
    hashed = units.select("doc_id", "text_hash", "pos", digest(F.col("unit")).alias("digest"))
    met = hashed.join(known, "digest", "left")
    line = F.when(F.col("pos") > 0, F.col("license"))
    rows = met.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("copies"),
        F.max(F.when(F.col("pos") == 0, F.col("digest"))).alias("text_sha256"),
        F.max(F.when(F.col("pos") == 0, F.col("license"))).alias("license"),
        F.concat_ws(",", F.array_sort(F.collect_set(line))).alias("line_licenses"),
        F.count(line).alias("_lines"))
    return rows.select("doc_id", "text_sha256", "license", "line_licenses",
                       F.expr("_lines div copies").alias("n_lines"),
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
