"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings, white space) and its digest is looked up among those of known licences:
entire texts by a hash join, and each of a text's lines (a notice usually stands on a
line of its own) in the array of the notices' digests. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# Spellings that the matching of licences takes as equal.
EQUAL = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("copyright owner", "copyright holder"),
    ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
# Fixed values: (licence, a whole text or a notice that stands for it).
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"), ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_TAIL}"),
    ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)


# Fixed values: (licence, digest of a whole published text in canonical form), with and without what follows its terms.
DIGESTS = (
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GPL-1.0", "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "ff38662d849bfd6bee2b3fe2f3d0493342dd10911b4f75afb26be0447927b976"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("GPL-3.0", "1d243e2f686217287f22005b96a11843e555353b8f4a92eea0ec5f532d924007"),
    ("GPL-3.0", "92f86bbf16b3c7beaf4c1a82ea5d81b358634e9123c8790121ec9fe76310a506"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)


# A line that begins with "copyright" is a notice (of a year, a mark, a name) unless one of these words follows, perhaps
# on the next line: then it is the text of a licence, wrapped there.
GOES_ON = "notices?|holders?|owners?|licen[cs]es?|licensors?|laws?|statements?|interests?|rights?|act|infringement|disclaimers?|protect\\w*|treat\\w*|and|or|in|of|is|to|that|this|on"
NOTICE = rf"(?m)^[^a-z0-9\n]*(copyright\b(?![^a-z0-9\n]*\n?[^a-z0-9\n]*(?:{GOES_ON})\b)|\(c\)|©|all rights reserved)[^\n]*$"


def _bare(text: Column) -> Column:
    """Lower case, copyright notices dropped, punctuation and white space to single blanks; lines stay apart."""
    out = F.regexp_replace(F.lower(text), NOTICE, " ")
    return F.regexp_replace(out, r"(?U)[^\p{L}\p{N}\n]+", " ")


def _spelled(bare: Column) -> Column:
    """Equivalent spellings of single words; each word and each line end stands between blanks."""
    out = F.concat(F.lit(" "), F.replace(bare, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in EQUAL:
        if " " not in other:
            out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return out


def _phrases(spelled: Column) -> Column:
    """Equivalent spellings of several words, within a line; without the outer blanks."""
    for other, usual in EQUAL:
        if " " in other:
            spelled = F.replace(spelled, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(spelled)


def _joined(spelled: Column) -> Column:
    """All lines as one, with single blanks."""
    return _phrases(F.concat(F.lit(" "), F.trim(F.regexp_replace(spelled, r"[ \n]+", " ")), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The form in which texts are compared: one line, its words between single blanks, spellings made equal."""
    return _joined(_spelled(_bare(text)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest, license: one row a known digest (as many as the parameters have, whatever the data)."""
    texts = spark.createDataFrame([(a, b) for a, b in known], "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    given = spark.createDataFrame([(a, b) for a, b in digests], "license string, digest string")
    return texts.unionByName(given).groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """One row a document: doc_id, text_license, line_licenses, n_notice_lines.

    text_license: of the known licence that the entire text is, else null. line_licenses:
    the licences, sorted, whose one-line notice is one of its lines; n_notice_lines: how
    many such lines. Every line is looked up, however long. Null and empty texts have
    none. Repeated rows are scanned alike; other columns of ``docs`` do not matter. Empty
    table: no rows. ``known``: (licence, text); ``digests``: (licence, digest of a text).
    """
    spark = docs.sparkSession
    table = known_digests(spark, known, digests)
    notices = known_digests(spark, [(a, t) for a, t in known if "\n" not in t], ())
    names = F.broadcast(notices.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("names")))  # one row, as many entries as ``known``
    base = docs.select("doc_id", _spelled(_bare(F.coalesce("text", F.lit("")))).alias("spelled")).crossJoin(names)
    hits = F.transform(F.split("spelled", "\n", -1), lambda x: F.element_at(F.col("names"), F.sha2(_phrases(x), 256)))
    base = base.select("doc_id", F.sha2(_joined(F.col("spelled")), 256).alias("digest"), let(hits, lambda h: F.filter(h, lambda x: x.isNotNull())).alias("hits"))
    base = base.select("doc_id", "digest", F.array_sort(F.array_distinct("hits")).alias("line_licenses"), F.size("hits").cast("long").alias("n_notice_lines"))
    return base.join(F.broadcast(table), "digest", "left").select("doc_id", F.col("license").alias("text_license"), "line_licenses", "n_notice_lines")  # as many rows as ``known`` and ``digests``
