"""Licence recognition by sentences: known sentences become identifiers, ordered rules match runs of identifiers.

A text is cut into sentences, and into lines, each normalised to lower-case words. A sentence of the table is
replaced by its identifier, a mere list number by '#', any other by a gap. Rules apply in their order to what earlier rules left; a
rule matches a run of identifiers without gaps, list numbers left out. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier. None holds a sentence's end inside.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software:",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "version-2-later": "either version 2 of the License, or (at your option) any later version.",
    "lgpl-free": "This library is free software;",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "version-2.1-later": "either version 2.1 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "bsd-allow": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "gpl2-only": "version 2.",
    "gpl2-only-license": "version 2 of the License.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-received-if-not": "If not, see <https://www.gnu.org/licenses/>.",
    "gpl-received-if-not-http": "If not, see <http://www.gnu.org/licenses/>.",
    "if-not-write": "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "agpl-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library;",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    "bsd-loss": "LOSS OF USE, DATA, OR PROFITS;",
    "bsd-theory": "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liable": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-short": "Licensed under CC0 1.0.",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}
# Sentences that name a holder, an organisation or contributors where {} stands, by the identifier of the sentence whose place they take.
HOLES = [
    ("bsd-names", "Neither the name{}contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "The name{}may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-liable", "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("isc-liable", "IN NO EVENT SHALL {} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit-liable", "IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-third", "Neither the name{}"),
]
# Rules in the order in which they apply. Longer runs come before their parts.
RULES = [
    ("BSD-4-Clause", ["bsd-allow", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-allow", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable", "bsd-loss", "bsd-theory"]),
    ("BSD-2-Clause", ["bsd-allow", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable", "bsd-loss", "bsd-theory"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liable"]),
    ("ISC", ["isc-grant-2", "isc-as-is", "isc-liable"]),
    ("0BSD", ["0bsd-grant", "isc-as-is", "isc-liable"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy-https"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-short"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy-https", "apache-as-is", "apache-see"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-later", "gpl-hope", "gpl-implied", "agpl-details"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-later"]),
    ("AGPL-3.0-only", ["agpl-notice"]),
    ("GPL-3.0-only", ["gpl-free", "gpl3-only-terms"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received", "gpl-received-if-not"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received", "gpl-received-if-not-http"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "version-2-later", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received", "if-not-write"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-only-terms"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-terms", "gpl2-only"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-terms", "gpl2-only-license"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "version-2.1-later", "lgpl-hope", "gpl-implied", "lgpl-details", "lgpl-received", "if-not-write"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-long"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-long"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-long"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "version-2-later", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "version-2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "version-2.1-later", "lgpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "version-2.1-later"]),
    ("BSD-3-Clause", ["bsd-allow", "bsd-source", "bsd-binary", "bsd-names"]),
    ("LicenseRef-BSD-variant", ["bsd-allow", "bsd-source", "bsd-binary", "bsd-third"]),
    ("BSD-2-Clause", ["bsd-allow", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-2"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-notice-3"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
]

#: A sentence ends with a mark before white space or the text's end, or with a blank line; list numbers and dashes at a sentence's start are dropped.
SENTENCE_END = r"[.!?:;]+([\t\n\f\r ]|\z)|\n[\t\r ]*\n"
LINE_END = r"[\r\n]+"
OTHER = "[^a-z0-9]+"
ITEM = r"^ ?[0-9] "
#: A list number or letter in brackets before a sentence.
MARK = r"^[^A-Za-z0-9(]*\(?([0-9]{1,2}|[A-Za-z])\)"
#: A list number or letter whose full stop ended the sentence: it counts as a sentence, but is no gap between its neighbours.
ITEM_ONLY = "^([0-9]{1,2}|[a-h])$"
#: A full stop after these ends no sentence.
SHORT = r"\b(Inc|Ltd|Corp|Co)\."
#: A tag that states licences by their identifiers, and what stands between these.
TAG, BETWEEN = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9(][A-Za-z0-9.+() -]*)", r"( (AND|OR|and|or) | WITH [^ ]+|[() ])+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    """The form in which sentences are compared: lower-case ASCII words, one space between, no item number."""
    words = re.sub(OTHER, " ", re.sub(MARK, " ", re.sub(SHORT, r"\1", sentence)).translate(str.maketrans(UPPER, LOWER)))
    return re.sub(ITEM, " ", words).strip()


def _form(sentence: Column) -> Column:
    words = F.regexp_replace(F.translate(F.regexp_replace(sentence, MARK, " "), UPPER, LOWER), OTHER, " ")
    return F.trim(F.regexp_replace(words, ITEM, " "))


def _ends(template: str) -> tuple[str, str]:
    """What stands before and after a template's hole, in the form in which sentences are compared."""
    before, after = (re.sub(OTHER, " ", x.translate(str.maketrans(UPPER, LOWER))).strip() for x in template.split("{}"))
    return before + " ", f" {after}" if after else ""


def rules_from_texts(texts: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules for whole licence texts, by licence: a rule is a text's run of sentences; longer runs come first. A table of any size is made this way, from a parameter."""
    sentences: dict[str, str] = {}
    rules = []
    for licence, text in texts.items():
        run = []
        for part in re.split(SENTENCE_END.replace(r"\z", r"\Z").replace("(", "(?:"), re.sub(SHORT, r"\1", text)):
            form = normalise(part)
            if form and not re.fullmatch(ITEM_ONLY, form):
                key = hashlib.md5(form.encode()).hexdigest()[:12]
                sentences[key] = part
                run.append(key)
        rules.append((licence, run))
    return sentences, sorted((r for r in rules if r[1]), key=lambda r: (-len(r[1]), r[0]))


def identifiers(text: Column, end: str, sentences: dict[str, str] = SENTENCES, holes: list[tuple[str, str]] = HOLES) -> Column:
    """Array of the identifiers of the text's non-empty sentences, '#' for those that are a list number, '-' for others that aren't known.

    Membership is one look into a hash set; only known sentences are looked up in the table, which is one literal, whose keys are passed through. A
    sentence that isn't in the table may fit one with a hole: the first that it begins and ends like.
    """
    forms = {normalise(s): k for k, s in sentences.items()}
    known = F.from_json(F.lit(json.dumps(forms)), "map<string,string>")
    lengths = [len(f) for f in forms] or [0]
    parts = F.split(F.regexp_replace(F.regexp_replace(text, SHORT, "$1"), end, "\x01"), "\x01")
    found = F.filter(F.transform(parts, _form), lambda s: s != "")
    is_known = lambda s: F.length(s).between(min(lengths), max(lengths)) & s.isin(list(forms))

    def told(s: Column) -> Column:
        told = F.when(is_known(s), F.try_element_at(known, s)).when((F.length(s) <= 2) & s.rlike(ITEM_ONLY), F.lit("#"))
        for name, template in holes:
            before, after = _ends(template)
            told = told.when(s.startswith(before) & s.endswith(after) & (F.length(s) > len(before) + len(after)), F.lit(name))
        return told.otherwise(F.lit("-"))

    return F.transform(found, told)


def tagged(text: Column) -> Column:
    """Array of the identifiers in the text's tags, in order, without exceptions."""
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    return F.filter(F.flatten(F.transform(tags, lambda t: F.split(F.regexp_replace(t, BETWEEN, " "), " "))), lambda i: i.rlike(r"^[A-Za-z0-9][A-Za-z0-9.+-]*$"))


def matched(found: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """The run of identifiers without list numbers as text, with what the rules matched replaced by [licence]; '' if no sentence is known."""
    start = F.array_join(F.transform(F.filter(found, lambda i: i != "#"), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    run = reduce(lambda s, rule: F.replace(s, F.lit("".join(f"<{i}>" for i in rule[1])), F.lit(f"[{rule[0]}]")), rules, start)
    return F.when(F.exists(found, lambda i: ~i.isin("#", "-")), run).otherwise("")


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, holes: list[tuple[str, str]] = HOLES) -> DataFrame:
    """Every row's whole text (columns doc_id and text are used, others ignored) with the licences that its sentences state.

    Returns doc_id, n_sentences, n_known (known sentences, or known lines if they are more), n_licenses, licenses (distinct,
    in byte order, comma-joined; '' for none) and statements (what rules matched by sentence and then
    by line, and what tags state, each in text order). Where a sentence begins as a third clause would, but is none that is known, two clauses
    before it aren't taken for a licence of two. A null or empty text has no sentences; null and repeated doc_ids each
    keep their row; no rows give none. ``sentences`` and ``rules`` may be the few hundred of this module, or any
    others, such as those of :func:`rules_from_texts`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select("doc_id", identifiers(text, SENTENCE_END, sentences, holes).alias("by_sentence"), identifiers(text, LINE_END, sentences, holes).alias("by_line"), tagged(text).alias("tags"))
    known = lambda c: F.size(F.filter(c, lambda i: ~i.isin("-", "#")))
    stated = lambda c: F.regexp_extract_all(matched(F.col(c), rules), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    told = ids.select("doc_id", F.size("by_sentence").cast("long").alias("n_sentences"), F.greatest(known("by_sentence"), known("by_line")).cast("long").alias("n_known"), F.concat(stated("by_sentence"), stated("by_line"), F.col("tags")).alias("statements"))
    names = F.array_sort(F.array_distinct("statements"))
    return told.select("doc_id", "n_sentences", "n_known", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), "statements")


def license_sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, n_sentences, n_known, n_licenses and licenses of :func:`license_scan`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map([" + ", ".join(quote(normalise(s)) for s in SENTENCES.values()) + "], [" + ", ".join(map(quote, SENTENCES)) + "])"

    def ids(end: str) -> str:
        parts = f"string_split(regexp_replace(regexp_replace(coalesce(text, ''), {quote(SHORT)}, '\\1', 'g'), {quote(end)}, chr(1), 'g'), chr(1))"
        form = f"trim(regexp_replace(regexp_replace(translate(regexp_replace(s, {quote(MARK)}, ' '), {quote(UPPER)}, {quote(LOWER)}), {quote(OTHER)}, ' ', 'g'), {quote(ITEM)}, ' '))"
        holes = " ".join(f"WHEN f LIKE {quote(before + '_%' + after)} THEN {quote(name)}" for name, template in HOLES for before, after in [_ends(template)])
        return f"[coalesce(known[f], CASE WHEN regexp_matches(f, {quote(ITEM_ONLY)}) THEN '#' {holes} ELSE '-' END) for f in [{form} for s in {parts}] if f <> '']"

    tags = f"list_filter(flatten([string_split(regexp_replace(t, {quote(BETWEEN)}, ' ', 'g'), ' ') for t in regexp_extract_all(coalesce(text, ''), {quote(TAG)}, 1)]), lambda i: regexp_matches(i, '^[A-Za-z0-9][A-Za-z0-9.+-]*$'))"

    def stated(c: str) -> str:
        runs = reduce(lambda s, rule: f"replace({s}, {quote(''.join(f'<{i}>' for i in rule[1]))}, {quote(f'[{rule[0]}]')})", RULES, f"array_to_string(['<' || i || '>' for i in {c} if i <> '#'], '')")
        return f"regexp_extract_all({runs}, '\\[([^\\]]+)\\]', 1)"

    return f"""
WITH k AS (SELECT {known} AS known),
ids AS (SELECT doc_id, {ids(SENTENCE_END)} AS by_sentence, {ids(LINE_END)} AS by_line, {tags} AS tags FROM {table}, k),
told AS (
  SELECT doc_id, len(by_sentence) AS n_sentences, by_sentence, by_line,
         list_sort(list_distinct(list_concat(list_concat({stated("by_sentence")}, {stated("by_line")}), tags))) AS names
  FROM ids)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences,
       CAST(greatest(len(list_filter(by_sentence, lambda i: i NOT IN ('-', '#'))), len(list_filter(by_line, lambda i: i NOT IN ('-', '#')))) AS BIGINT) AS n_known,
       CAST(len(names) AS BIGINT) AS n_licenses, array_to_string(names, ',') AS licenses
FROM told"""
