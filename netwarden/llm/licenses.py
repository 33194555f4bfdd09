"""License texts and notices: templates with optional and replaceable regions, run as token automata.

A template is its wording with two kinds of markup: ``[[ ... ]]`` encloses words that may be missing, and
``{{n}}`` stands for up to ``n`` words of any kind. It is compiled once into an automaton over words;
a text is accepted where the mandatory words follow each other exactly, with nothing between them but
what the markup allows. Texts are scanned for a template's first mandatory words, and the automaton runs
from there.

Labels that end in ``-text`` stand for a license's whole wording and ``-header`` for the whole notice that
its publisher prescribes; ``-notice`` is a sentence that names a license.

Words are runs of letters and digits (and any character beyond ASCII) after A-Z were lower-cased.
Defined cases: a null or empty text has no words, no labels, score zero and no places; repeated rows and
null ids are answered row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_MIT = """
[[The MIT License (MIT)]] [[Copyright (c) {{20}}]]
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
{{8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD = """
[[Copyright (c) {{20}}]] Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: [[1]] Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. [[2]] Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
[[3]] Neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
{{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
_APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at [[http]] [[https]] www apache org licenses LICENSE 2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.
"""
_GPL = """
This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version {{2}} of the License, or (at your
option) any later version.
[[This program]] [[It]] is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.
"""
# Templates: label -> wording with markup. Fixed values.
TEMPLATES = {
    "mit-text": _MIT,
    "bsd-2-text": _BSD + _BSD_END,
    "bsd-3-text": _BSD + _BSD_NAME + _BSD_END,
    "isc-text": _ISC,
    "apache-2.0-header": _APACHE,
    "gpl-header": _GPL,
    "apache-2.0-notice": "Licensed under the Apache License[[,]] [[Version]] 2.0",
    "mit-notice": "[[is]] Released under the [[terms of the]] MIT License",
    "gpl-3.0-notice": "licensed under the [[terms of the]] GNU General Public License[[,]] [[version]] 3",
    "gpl-2.0-notice": "licensed under the [[terms of the]] GNU General Public License[[,]] [[version]] 2",
    "cc-by-4.0-notice": "Licensed under [[a]] [[Creative Commons]] CC BY 4.0",
    "cc-by-nc-4.0-notice": "Licensed under [[a]] [[Creative Commons]] CC BY NC 4.0",
    "cc-by-sa-4.0-notice": "Licensed under [[a]] [[Creative Commons]] CC BY SA 4.0",
}

_TO_WORDS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """States in order: a word to read, a gap of up to ``n`` words, or a choice to skip ahead."""

    def __init__(self, template: str):
        self.code: list[tuple[str, object]] = []
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template, re.S):
            if part == "[[":
                opened.append(len(self.code))
                self.code.append(("skip", 0))
            elif part == "]]":
                self.code[opened.pop()] = ("skip", len(self.code))
            elif part.startswith("{{"):
                self.code.append(("gap", int(part[2:-2])))
            else:
                self.code += [("word", w) for w in words_of(part.encode())]
        self.mandatory = self._mandatory()
        # The words before the first markup that follows a mandatory word are looked up in the text.
        first = min(self.mandatory)
        anchor = []
        for kind, value in self.code[first:]:
            if kind != "word":
                break
            anchor.append(value)
        self.first, self.anchor = first, b" " + b" ".join(anchor[:4]) + b" "

    def _mandatory(self) -> set[int]:
        optional: set[int] = set()
        for at, (kind, value) in enumerate(self.code):
            if kind == "skip":
                optional.update(range(at, value))
        return {i for i, (kind, _) in enumerate(self.code) if kind == "word" and i not in optional}

    def _closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            at = state[0]
            if at < len(self.code):
                kind, value = self.code[at]
                if kind == "skip":
                    todo += [(at + 1, 0), (value, 0)]
                elif kind == "gap":
                    todo.append((at + 1, 0))
        return seen

    def run(self, words: list[bytes], start: int) -> float:
        """Share of the mandatory words read from ``start`` on; 1 if the template is accepted."""
        states, furthest = self._closure({(self.first, 0)}), self.first
        for place in range(start, len(words)):
            word, after = words[place], set()
            for at, used in states:
                if at < len(self.code):
                    kind, value = self.code[at]
                    if kind == "word" and value == word:
                        after.add((at + 1, 0))
                    elif kind == "gap" and used < value:
                        after.add((at, used + 1))
            states = self._closure(after)
            if not states:
                break
            furthest = max(furthest, max(at for at, _ in states))
            if furthest >= len(self.code):
                return 1.0
        return min(sum(i < furthest for i in self.mandatory) / len(self.mandatory), 0.99)


def _places(joined: bytes, phrase: bytes):
    """Word numbers at which ``phrase`` begins in words joined and enclosed by single spaces."""
    at, number, last = joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", last, at)
        last = at
        yield number
        at = joined.find(phrase, at + 1)


def match(text: bytes | None, automata: dict[str, Automaton]) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score)`` of one text."""
    words = words_of(text or b"")
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        found = list(_places(joined, b" " + phrase.encode() + b" "))
        places += found
        if found:
            base.add(label)
    labels, score = set(base), 0.5 if base else 0.0
    for label, automaton in automata.items():
        for start in _places(joined, automaton.anchor):
            share = automaton.run(words, start)
            score = max(score, share)
            if share == 1.0:
                labels.add(label)
                break
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Base places, labels and the best score of every row; nothing is shuffled."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(row_id), F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([docs.schema[row_id], *SCHEMA.fields])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        automata = {label: Automaton(template) for label, template in templates.items()}
        for batch in batches:
            found = [match(t.as_py(), automata) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return rows.mapInArrow(run, schema)


