"""Licence scan by canonical digests.

Texts are brought to a canonical form: lower case, copyright notices taken out, equivalent spellings made one, every
run of punctuation and white space one space. The digest of the canonical form is joined with the digests of known
licence texts and notices. Looked up are the entire text, every paragraph and every line, each as a whole: a text is
found however it is set, broken or spelled, and never because it shares a few words with a licence.

The known texts are those of this file (full texts of MIT, ISC, 0BSD, BSD-2-Clause and BSD-3-Clause, the Apache notice, the
usual one-line notices and SPDX declarations) and any table of further ones that the caller passes; only units with the
length of a known text are digested and joined. Null and empty texts have no licence. Texts of repeated rows are each
reported; other columns are kept, columns that bear a new name are replaced. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.session import cut

# Equivalent spellings, the second of each pair is used.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("noninfringement", "non infringement"), ("sublicense", "sub license"),
    ("per cent", "percent"), ("copyright holder(?:s)?", "copyright owner"), ("https", "http"), ("gnu gpl", "gnu general public license"),
)
#: Spellings of several words, between which a line end may stand.
ACROSS_LINES = tuple(x for x in SPELLINGS if " " in x[0])
# What is taken out: a notice (copyright or (c), then a year, its placeholder or a sign) up to the line end or to words
# that open a licence, and 'all rights reserved' alone on a line. No group repeats, so long lines take no stack.
_YEAR = r"[<\[{]?(?:[0-9]{4}|year|yyyy)\b"
_SIGN = r"(?:\(c\)|©)"
OPENS = (r"permission\s+(?:is|to)\b|redistribution\s+and\s+use\b|licen[cs]ed\s+under\b|released\s+under\b|spdx-licen[cs]e|"
         r"this\s+(?:program|library|software|file|work)\s+is\b")
_MARGIN = r"^[ \t#*/;-]*"
NOTICE_HEAD = rf"{_MARGIN}(?:copyright[ \t:,]*(?:{_SIGN}|{_YEAR})|{_SIGN}[ \t]*(?:copyright[ \t]*)?{_YEAR})"
RESERVED = rf"{_MARGIN}all rights reserved[ \t.]*"
NOTICE = rf"(?m){NOTICE_HEAD}[^\n]*?(?={OPENS}|\n|\z)"

# The two- and three-clause BSD texts share their opening, two conditions and disclaimer.
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Identifiers of which the usual one-line declaration is known.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)

# Licence texts and notices by SPDX identifier.
KNOWN = (
    ("BSD-2-Clause", "text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "text", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    *((name, "notice", f"SPDX-License-Identifier: {name}") for name in SPDX),
)


def folded(text: Column) -> Column:
    """Canonical but for line ends: these stay, so that lines and paragraphs can be told apart."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE, "")
    out = F.regexp_replace(out, rf"(?m){RESERVED}(?=\n|\z)", "")
    for found, used in SPELLINGS:
        out = F.regexp_replace(out, found, used)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(part: Column) -> Column:
    out = F.trim(F.regexp_replace(part, r"\s+", " "))
    for found, used in ACROSS_LINES:
        out = F.regexp_replace(out, found, used)
    return out


def known(spark, texts: DataFrame | None = None) -> DataFrame:
    """``digest``, ``licence`` and ``length`` of the texts of this file and of ``texts`` (columns licence, text)."""
    rows = spark.createDataFrame(KNOWN, "licence string, kind string, text string").select("licence", "text")
    rows = rows if texts is None else rows.union(texts.select("licence", "text").where("licence is not null and text is not null"))
    form = canonical(folded(F.col("text")))
    return (rows.select("licence", F.sha2(form, 256).alias("digest"), F.length(form).alias("length"))
            .where("length > 0").distinct())


def scan(df: DataFrame, text_col: str = "text", carry: tuple | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``carry`` columns of ``df`` (all by default) with ``licences`` (sorted, joined by commas), ``n_matches`` (units
    that are a known text) and ``whole_text`` (the entire text is one). ``texts`` (licence, text) adds known texts."""
    table = known(df.sparkSession, texts)
    lengths = sorted({r["length"] for r in table.select("length").collect()})
    kept = [c for c in (df.columns if carry is None else carry) if c not in ("licences", "n_matches", "whole_text")]
    form = df.withColumn("__form", folded(F.col(f"`{text_col}`")))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("__form")).alias("unit"))),
        F.transform(F.array_distinct(F.concat(F.split("__form", r"\n *\n"), F.split("__form", r"\n"))),
                    lambda u: F.struct(F.lit(False).alias("whole"), canonical(u).alias("unit"))))
    rows = cut(form.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__row"),
                           F.filter(units, lambda u: F.length(u.unit).isin(lengths)).alias("__units")), "licences")
    looked = rows.where(F.size("__units") > 0).select("__row", F.explode("__units").alias("u")).select(
        "__row", "u.whole", F.sha2("u.unit", 256).alias("digest"))
    # The texts of this file are a small table, which Spark broadcasts by its size; a user's may be larger.
    found = (looked.join(table.select("digest", "licence"), "digest").groupBy("__row")
             .agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
                  F.count_if(~F.col("whole")).alias("n_matches"), F.max("whole").alias("whole_text")))
    some = rows.where(F.size("__units") > 0).join(found, "__row", "left")
    none = rows.where(F.size("__units") == 0).select(
        "*", F.lit(None).cast("string").alias("licences"), F.lit(0).cast("long").alias("n_matches"), F.lit(False).alias("whole_text"))
    return some.unionByName(none).select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"))
