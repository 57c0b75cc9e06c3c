"""License scans by canonical digest lookup.

A text is brought to a canonical form: ASCII lower case, copyright lines dropped (not body lines that begin so), punctuation and white space to single
spaces, equivalent spellings to one. Its digest is looked up among the digests of known licence texts and notices, first
for the entire text, then for each of its lines (a notice line inside a document) and each paragraph between blank
lines. The known table is a constant of the module, so the hash join may broadcast it whatever the size of the input.

Only DataFrame functions; nothing is shuffled but the few findings.

Defined cases: null and blank texts match nothing; a text that is only a copyright line has an empty form, which is no
licence; repeated rows count their findings together; a unit that is the entire text is reported as ``text`` only;
other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import fold, whole_text

# Spellings that licence matching treats as equal, by canonical word.
SPELLINGS = [
    (" licence", " license"), (" sub license", " sublicense"), (" sublicence", " sublicense"), (" non commercial", " noncommercial"), (" per cent ", " percent "),
    (" organisation", " organization"), (" authoris", " authoriz"), (" recognis", " recogniz"), (" merchantibility ", " merchantability "),
    (" favour", " favor"), (" fulfil ", " fulfill "), (" judgement ", " judgment "), (" acknowledgement", " acknowledgment"),
    (" copyright owner", " copyright holder"), (" https ", " http "), (" www ", " "), (" v2 0 ", " version 2 0 "), (" v3 ", " version 3 "),
]
#: A line that begins with "copyright" as part of a sentence (holders, notice, law, and ...) belongs to the body.
COPYRIGHT = r"(?i)^[\s/*#;>\-]*(?:copyright\b(?!\s*[,;.)]|\s+(?:holders?|owners?|notices?|laws?|licen[sc]es?|statements?|ownership|interests?|protection|treaty|disclaimers?|rights?|permission|and|or|in|on|to|is|of|for|as|that|which)\b)|\(c\)\s|©|all rights reserved\b).*$"

# Wording of public licences and customary notices.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """ + _WARRANTY),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# Names by which a one-line notice cites a licence.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "the MIT licence", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"],
}
#: Digests of the canonical forms of whole licence texts as in /usr/share/common-licenses: with and without title,
#: preamble and appendix. AGPL, CC-BY and the Unlicense were not at hand.
FULL = {
    "Apache-2.0": "2e02225cf48fe9cab997c6341158a3ea 31e2315b14f584fe9b2c5a59c9323e2a 060baa49ffc2d7a1e14783969af6c570 17cca6e93a43d2a35d3cecb17efe7012 10a69ed87d520fc71134cae6749c7d4b 930a7de414e5540b78dfc5cb6a0bc6c5 7ae257b5afd97b946e837078b4ce2a8f 22a296c4cddf5b7f72e1c0cfa22049c2 c9ddcc9a2e438a2f12d8b96d4b53f358 2a09af07a7175341a3e1e27968375103 e8d2bed608a4c18fe774edf6e14457cf f7b1cd6c4909abb823f609258faf44cc d29ec64b2fc3b6288bd603353c001739 5e9e6c1a44c38f2637b46910e97753bf 75c188b303320cc0eccc96294552e4e2 fa14e26ac416124bdb66a11679e44883".split(),
    "Artistic-1.0-Perl": "a8b0fb0c6e43a3b36bdc159e59dbfd1e 5f42cbb9b1312d2c97663250a76ee346 44b366b9a241591bc39a79b021daa9ca".split(),
    "CC0-1.0": "93a180096f6cfcf2c0dd24f75c2eec48 8fb0e14e19338d959f2006bd9aa88fc7 1ac6a3ac637951e56bd250aaa3e687a0 fa8a03d1b9df2c6dbd261e2159fa72bd".split(),
    "GFDL-1.2": "0f7454f096c1162d0d2d34f9cf4be0de 5bf5dc2a15756ef548b01676de71cf17 23b69e9fc1ffbb6ebdfad2a26d02271e b04d40470df358bc98f9595ccadebe43 77ac696cc2931f4dc7f6fc60b1678139 5d357581f0b653472acb07de07be656e 0e315271a439030460d86a009f43454f 570b7b5c2208587f068c11a4a35a09de 57dcb96808b5cb04e945de68f392a23f 23c7a67204e7fcd3adab3f6861029aa9 2328cdff794ce1c55bac98b1f21fc785 5c029eb736afd20103404159f29485e3".split(),
    "GFDL-1.3": "a5f4e54aad660dd242170ddcf2625b9a 26d3e5e7bbcf4b801dfd74ed69561fc4 9b7afd9ee25d22048192c284464ade8b 0f1bcb253372b4f1e0a65f2edf00ec66 ebc8af64569039281489d7516894d078 99169e78e68a848d74c61857f34451fe d0cdfda857ecaa6fad7d49f30e69f613 9a981eb87fb76745d36b7363d71b6491 c75f88ffd851780b9399860391b998ab 0d17c5df3a146e7fb588228522ef1b65 96f44be104a3c59c7da9481dd5162718 759b19ebf1d412350079dc731075c56e".split(),
    "GPL-1.0": "738cc3b112640d95d4cd79a58967ecea 21fa8693acc5194a648fe02e11f65a72 dbf3c47f5a8f127e58d08cabc1ebb916 5c1cde8c7975571de13e917143931d62 bc6f4969be471bce8ecadc094597a42f 2b694028d131ae8783188a23158281d6 77e61efdcfc6f0eac97d2dbb3e43f0fe a85ddbae4b0bf7d2822a4edf01ca51d3 e4da8f8ae59ddbd8ff2939da6264be17 37568ce4cada0816ecc642efe89eac4e 43b270b91b142a4f1c724e6ce5e885bd 3cae58c564bd007093c44926b42897fb f3ad5f2f8d44719b2b03e4ad7f16067d 999c98f58dee16b8030e12ae4197f914 1065c8ea1bfb7632a7cd6adaba979870 9efe398fef06ffa68f498632b58f1cff 665c47496120d882e07886628939fce7 034729427d26f6892a387553f880b584 832b40771502f7fb25c3d7befe802cef 7ee8d14529165331546e2278611c321e b75c23e5f9b60a49460b8d3b3825a5e0 f17e41e097bf40134019ed2d407346f3 ddcb0a395eb768f37a6e17a44139f4a9 7de27fb242d6b203bbc14bba976a1241".split(),
    "GPL-2.0": "5e39ace6e62f5a7fe9c17b4da986ad8c f2c06efe640b4a281cbe5337cdde80ab 68380dbeadb093b94ecf563db7312db7 4ea77fb39c7fdbfce4c5ffd96f307484 ae1bfa6bac15855cc9929c52b204b76d 11bea0b8b3382bba5cecc56b5f1ccc9f a4d0d6285d899fa42a759866815c6c55 4e9d754d39bb07bfa409af54ef4fd186 203a41374475f17bf2e7cdf6e02380c3 f071581ca8bb0d9bdeb5c0d37787a8f4 60467d3a86cf377f0ae1d1f6d064a6d2 814ee5a7ccced86072a7de3abe8f2d23 c86b7e05f69c4ae379e8486562dd20f1 adda57d0f6698f9d83368a4ab0dda083 513bc60d9cca85efe97e78048af51966 6d2e4f5000289e9c86bcba3254253ce5 7471b6502417686faf0d543a4d6ca16e d703677cf5dbd2e2e3181402bd7fc529 c985a15e0956369c4ee2c5a975632cb2 7253bcb2181dc6148386099eca41fcc2 50f1b2b6deafc2d1148cb47641ea1ce0 d4941d7127434176d3d50e77260a2d6d f89562de8487ec69dc51eb00d2de9123 3070d945d7e6b45493206743e9efefc2 035c6642866f07f3ef16a7f12e8295ee 3ab5b2c73107371560bb1051ca6d8366 e36d0db878ce50983f5208c5eac69b27 fede3333887668b950e422691b0bf242 bfa270652b2ee46b1a069120be7c8436 57dae875e4e0088751ba2baf1d276391 664b50109aaebd35881a60272e669c25 94012af6f55c227f763ae263c2e798fe".split(),
    "GPL-3.0": "fa7cc127b1fb63bada5d27615be7bcb5 17e434cc6db7003444b088cb4cc81e91 444f95dc767ede978b60cfb20fbd0bca 8bfbf143238abf21a41272d936097fd9 89a0193eb7fb931ec1b347cb80513d62 886478e429d02b6ed153f7ea08031dcd 9e22d5b18034d08a50924d5bbe573dde 1772c8da4b29dc886c63350ecd1ad18d f35902faf11e04ac6cb9733cc5e27011 b3d67be3ad6fcd4cf74c40d3ad39393d 27ba45692f8421bdfdc38467d0154e2d 79a435d1ef44b90fb639feb15af65e58 1284f62a81fb8f7b0fb9cfdb8c503501 7ef16bd808a93bb7eeae3ad376f92bf2 4f16e3a448ec920ed5b538ea25d8a893 84e44946d145f8bbfdd6f0ce5f756636 32930c53bfaeb7cdbb137639f0b62cf9 e7c4223c8529e09e61cd4ce975e5c9be 6be538dcfea1d0554fe0bc6c17a50fa9 2bbe5eeab66c3eeabd339245a23c9e89 bfc52d1ea3776f7f31c947cf30702862 2e8c6e289109ff6d4b328a6d53d72358 d0d526ad980e9175c7ff53d069d6bf27 8f093436f01d6b0197c8ebd6e15d73e5 2a02fcd7965aeff6daa939cedbfecbed 41d67e4be17d6fa64220e205769c27c6 03df3f06f9d669598c176b029123f098 652e1685f2c22f3b121910fc17627c4c 320b6cdc5b05520736155cd46933ed8a 97ed56e5c55a6d427bdbf2e5ad0d5800 b585be0cf2ff3e9362303bb637995e26 e92cc797b9382fd09cad03ede6a93473".split(),
    "LGPL-2.0": "74cf7fcef3b29a39165a795b2cad3a3a 97832943be1e344d51af5aee1b658e4f c396ba2f94537628797123bc12cd2d6e 5981eac23199b9648527668fe0a72da5 8d33238ebbe794ebc424bddcd5821809 424a4ac206ccf77494cebba69867b565 ad22948d6e200839a6244505740534d5 0e3c4ed2892f427f40283d397c0c6fa1 4e2dba6f670cb8149d24c897dad4a898 951c626ad41b439facf3773b5bbb4505 fe9fc498f3f1afd70ab517ec71a8a7e3 1a26506075f56877bd7a5ada37a243f0 7635abe16d4f0e5d50aa8f53dc87c1dc 925cd3f297b753e67d0ad55a14018ca9 9e11fca3c297d25d4af63987125a7fd0 bbc6e399d11d667f0a3b7696dacfa043 f1ac25dbc83534a9b7aecaaca65a5cc0 85daa497d26155174a9df08224a2c232 83334ce9b51bf6b0252a32aa55a6bd5a 203c0a6015e1bbacca5295f1f51f2a5f f0ac4b3aca4a1ccfde49d9e95294199d 1bade989ec95c2761e9da12b5f7923a4 108a884c671c3a932315451b492431d8 ec3bb98beee5d4a7ac5dbc4e7ba02519 261041a786b1661b358382ef6a0e4718 7588205d0663eadc2c769428efdbc982 37082833095700a8b08e72ce3cb7cca7 5e7064da37da7f00c4509099a05abf59 a34861e6f66450057d08c3192f8b454b 9bd9bd9f3e7b37551b243b4f26b948e4 6c4299486b1aa80b8198a9d060cf4b5d ff65ac5d9d29c86deabd2b5e415105ba".split(),
    "LGPL-2.1": "f998bc436710cfece156aaa84fd26dd4 eaf6afb73fc860a002bfbccbe6f07ce7 3054b3781b1af43f906dc753acad15ee 551b136245e9bfdecfd7ddcf21da8ab5 fcd884024b53f200512e72231e266c2d 302df7c4aec4539fe823e83a6732bafc 3d6da5489ffd71a1c12cba6e79fe98c4 67de67f3a6b3bdec285e6592b15e7809 f490feb302f9d19ca2f14d4122df0cc7 505b7d096a455db7bf89fc7270a71222 6948d211fdd5c578291e3bec48d5a3ae 94d1a65f799f6073a616900255d30061 469b325e1e3630601f3dd2ef6d91cd19 71c2726d9e90169b7d92bcc09c90b8ca 70b7d21f82b978135d65cf7a86d46b6a dbec49a82d85f05c8667e195827e58ab 99f99be5f200b87b7fe8f8f3bc2c1324 a8cae27058a67d9da9e48ac895e0f936 c91d1e54508b9b84ae7f2ff27a712396 ccc19a396b843184dcaeb1bcdf4a6adc 2d8ea80f24cdbce9ff8178c8f7838274 46259c1a7f9fe6d314664fc185a2338d cde90cd0e82ab6e7f1e38be50a0c28db 13fb0f145dabdfd48f2397575806e04c 43bf84c2a0ada4ec1036747b1a65f69b 81f54b99001ecb7e6341ee4714562b1f 69c564f57544d60378ce6e5229de7d94 b148d995c1abbac2d8ce564645739ffa 9c45cf1b455f75a34b2035910ad1dc79 90b400ecd8efecbf2e1465fe240ea32c 831e292c78b816e1a9fdba07c006b1b4 408c5264cab35c0daee492762360148a".split(),
    "LGPL-3.0": "b31b7335bc37919e8cdd79154e04d88d 33fad1678ccee0a0d16f8788ad08749e 1b8dd7a9c66d7a25c54515f3aa622e66".split(),
    "MPL-1.1": "abcadd41fa3e8715ecf9f3adb48a91fc fe448c137d57f580a7e10b9a06ee657d d8e01b61080399b7484b866cac357b35 1124ff56550eac67fbc400154c99b470 5ad9224bc6b22e3562cae808e932f425 afb4c3fbd93801afac0b1323febe0942 5f70650b346d39648cf30c7abbed537f 2ef371aa2bcba35f80a60972b712d717 fcdea26e0cb6a2a9b4b8b6ce70d046d6".split(),
    "MPL-2.0": "0d0c617863ffeb16c5cb1f094c2d68b2 e4dcd8d38e594750386e39c960c18aec 1eea96f32d3a1ffe3bf6c2cbc3029915 0fd73770a20040e1628fb07465e54b5c 4e069da9eb95b0dbb2aec93f95177254 50630a982b838609a6318d2da8add11a 5c277aef3bdf9fa7e9d9d62980932627 aae0e4dc8193d8e3b746fefab3d4f365 6783dcb496a7a648b3bd2ae5459a5c4c".split(),
}
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This file is licensed under {}.", "Available under {}.", "License: {}", "SPDX-License-Identifier: {}", "Licensed under the terms of {}."]


def canonical_text(text: str) -> str:
    """Canonical form of one known text; the column form below follows the same steps."""
    lines = [x for x in text.split("\n") if not re.match(COPYRIGHT, x)]
    s = " " + re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), "\n".join(lines))).strip() + " "
    for a, b in SPELLINGS:
        s = s.replace(a, b)
    return s.strip()


def known_digests() -> list[tuple[str, str]]:
    """(digest, license) of every known form; titles may stand before a full text."""
    rows: dict[str, str] = {}
    for name, body in KNOWN:
        for text in (body, f"{name} {body}", *(f"{n} {body}" for n in NAMES.get(name, []))):
            rows.setdefault(md5(canonical_text(text).encode()).hexdigest(), name)
    for name, cited in NAMES.items():
        for c in cited:
            for n in NOTICES:
                rows.setdefault(md5(canonical_text(n.format(c)).encode()).hexdigest(), name)
    for name, digests in FULL.items():
        for d in digests:
            rows.setdefault(d, name)
    return sorted(rows.items())


def canonical(text: Column) -> Column:
    """Canonical form of a text whose copyright lines are already gone."""
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(s)


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_digests(), "digest string, license string")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, unit, n_found of every document with a known licence text or notice."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.filter(F.split(whole_text(), "\n"), lambda x: ~F.regexp_like(x, F.lit(COPYRIGHT)))).alias("l"))
    t = t.select("doc_id", "l", fold(F.concat_ws("\n", "l")).alias("t")).filter("t <> ''")
    lines = F.when(F.size("l") > 1, F.transform("l", lambda x: F.struct(F.lit("line").alias("unit"), x.alias("u")))).otherwise(F.array())
    parts = F.when(F.regexp_like("t", F.lit(r"\n[ \t]*\n")), F.transform(F.filter(F.split("t", r"\n[ \t]*\n"), lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(F.lit("paragraph").alias("unit"), x.alias("u")))).otherwise(F.array())
    units = F.concat(F.array(F.struct(F.lit("text").alias("unit"), F.col("t").alias("u"))), lines, parts)
    # A unit without a letter or digit has an empty form; so has no digest in the table.
    u = t.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.unit", F.md5(canonical(F.col("x.u"))).alias("digest"))
    return u.join(F.broadcast(known_table(docs.sparkSession)), "digest").groupBy("doc_id", "license", "unit").agg(F.count("*").alias("n_found"))


def scan_sql(relation: str = "documents") -> str:
    table = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    form = "' ' || trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    copyright_ = r"(?i)^[\s/*#;>\-]*(?:copyright\b|\(c\)\s|©|all rights reserved\b).*$"
    return rf"""
    WITH known(digest, license) AS (VALUES {table}),
    l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '{copyright_}')) AS l FROM {relation}),
    t AS (SELECT doc_id, l, array_to_string(l, chr(10)) AS t FROM l),
    u AS (SELECT doc_id, 'text' AS unit, t AS u FROM t WHERE t <> ''
          UNION ALL SELECT doc_id, 'line', unnest(l) FROM t WHERE t <> '' AND len(l) > 1
          UNION ALL SELECT doc_id, 'paragraph', p FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t]*\n')) AS p FROM t WHERE regexp_matches(t, '\n[ \t]*\n')) WHERE contains(p, chr(10))),
    d AS (SELECT doc_id, unit, md5(trim({form})) AS digest FROM u)
    SELECT doc_id, license, unit, count(*) AS n_found FROM d JOIN known USING (digest) GROUP BY ALL"""
