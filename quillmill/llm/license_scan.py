"""License scans by template-markup matching.

A template is license wording with the markup of the SPDX license list: ``<<beginOptional>> … <<endOptional>>``
around words that may be left out, ``<<var;name="…";original="…";match="…">>`` for a region that may be replaced.
Each template is compiled into an automaton over tokens; it accepts a stretch of a text if all mandatory words
are there in order and nothing stands between them but what the markup allows.

A token is a run of letters and digits in lower case, so white space, case and punctuation don't matter.  The
match of a region is ``.{m,n}`` (so many tokens of any kind) or a list of literal alternatives ``a|b c``.

Scale: the JVM keeps only texts that hold, for some template, one word that it can't do without; only those go
to Python.  There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.textbatch import slices

_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)\b(.*?)>>", re.S)
_MATCH = re.compile(r'match="(.*?)"', re.S)
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")

_LINK = '<<beginOptional>> (<<var;name="link";original="";match=".{1,8}">>) <<endOptional>>'
_VERSION = '<<beginOptional>>,<<endOptional>> <<beginOptional>>Version<<endOptional>>'



def _opt(words: str) -> str:
    return f"<<beginOptional>>{words}<<endOptional>>"


def _region(match: str) -> str:
    return f'<<var;name="region";original="";match="{match}">>'


def _notice(name: str, version: str) -> str:
    """The notice that the licenses of the GNU project ask for, with "or later" or without."""
    by = "as published by the free software foundation"
    return f"under the terms of the GNU {name} " + _region(f"{by} either version {version}|version {version} {by}|v{version} {by}|{by} version {version}|version {version}")


_MIT_END = (
    " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    " IN NO EVENT SHALL " + _region(".{1,12}") + " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    + _opt("1") + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    + _opt("2") + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY " + _region(".{1,14}") + " AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL " + _region(".{1,14}") + " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

#: license id -> template
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0",
    "MIT": '<<var;name="verb";original="Released";match="released|licensed|distributed|available|provided">> under the <<beginOptional>>terms of the<<endOptional>> MIT License',
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of " + _region(".{2,12}") + ", to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice " + _opt("(including the next paragraph)") + " shall be included in all copies or substantial portions of the Software." + _MIT_END,
    "GPL-2.0": '<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> <<var;name="v";original="version";match="version|v">> 2<<beginOptional>>.0<<endOptional>>',
    "GPL-3.0": '<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> <<var;name="v";original="version";match="version|v">> 3<<beginOptional>>.0<<endOptional>>',
    "CC-BY-4.0": "Licensed under <<beginOptional>>a<<endOptional>> <<var;name=\"cc\";original=\"CC BY\";match=\"cc by|creative commons attribution\">> 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>",
    "CC-BY-NC-4.0": "Licensed under <<beginOptional>>a<<endOptional>> <<var;name=\"cc\";original=\"CC BY-NC\";match=\"cc by nc|creative commons attribution noncommercial\">> 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>",
    "CC-BY-SA-4.0": "Licensed under <<beginOptional>>a<<endOptional>> <<var;name=\"cc\";original=\"CC BY-SA\";match=\"cc by sa|creative commons attribution sharealike\">> 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>",
    "BSD-3-Clause": _BSD + _opt("3") + " Neither the name of " + _region(".{1,12}") + " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_END,
    "BSD-2-Clause": _BSD + _BSD_END,
    "ISC": "Permission to use, copy, modify, and" + _opt("/or") + " distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND " + _region(".{1,12}") + " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL " + _region(".{1,12}") + " BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "GPL-2.0-notice": _notice("General Public License", "2"),
    "GPL-3.0-notice": _notice("General Public License", "3"),
    "LGPL-2.1-notice": _notice("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _notice("Lesser General Public License", "3"),
    "AGPL-3.0-notice": _notice("Affero General Public License", "3"),
    "CC0-1.0": _region("cc0|creative commons zero") + " " + _opt("v") + _opt("version") + " 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "SPDX-tag": 'SPDX-License-Identifier: <<var;name="id";original="";match=".{1,1}">>',
}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Automaton:
    """Token automaton of a template: states 0..n, edges (token or None for any, to), and moves without a token."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        #: the template as nested parts, for expression(): str, ("opt", [..]), ("any", m, n), ("or", [[..], ..])
        self.parts: list = []
        stack: list[tuple[int, list]] = []
        parts, at, state = self.parts, 0, 0
        for m in [*_MARK.finditer(template), None]:
            for token in tokens(template[at : m.start() if m else len(template)]):
                state = self._step(state, token)
                parts.append(token)
                if not stack:
                    self.mandatory.append(token)
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                inner: list = []
                parts.append(("opt", inner))
                stack.append((state, parts))
                parts = inner
            elif m[1] == "endOptional":
                start, parts = stack.pop()
                end = self._new()
                self.free[state].append(end)
                self.free[start].append(end)
                state = end
            else:
                match = _MATCH.search(m[2])
                if match and (bounds := _ANY.fullmatch(match[1])):
                    low, high = int(bounds[1]), int(bounds[2])
                    parts.append(("any", low, high))
                    exits = [state] if low == 0 else []
                    for k in range(1, high + 1):
                        state = self._step(state, None)
                        if k >= low:
                            exits.append(state)
                    end = self._new()
                    for x in exits:
                        self.free[x].append(end)
                    state = end
                else:
                    ways = [tokens(w) for w in (match[1] if match else "").split("|")]
                    if not match or not all(ways):
                        raise ValueError(f"a region needs a match of .{{m,n}} or of words: {m[0]}")
                    parts.append(("or", ways))
                    end = self._new()
                    for way in ways:
                        s = state
                        for token in way:
                            s = self._step(s, token)
                        self.free[s].append(end)
                    state = end
        if stack or not self.mandatory:
            raise ValueError("a template needs an end for each beginning and some mandatory word")
        self.accept = state
        self.anchor = max(self.mandatory, key=len)
        self.closure = [self._closure(s) for s in range(len(self.edges))]

    def _new(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _step(self, state: int, token: str | None) -> int:
        to = self._new()
        self.edges[state].append((token, to))
        return to

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def starts(self) -> set[str | None]:
        """The tokens that a match can begin with."""
        return {t for s in self.closure[0] for t, _ in self.edges[s]}

    def match_at(self, words: list[str], at: int) -> int:
        """End of the shortest match that begins at word at, or -1."""
        states = self.closure[0]
        while self.accept not in states:
            if at >= len(words):
                return -1
            word = words[at]
            states = frozenset().union(*(self.closure[to] for s in states for t, to in self.edges[s] if t is None or t == word))
            if not states:
                return -1
            at += 1
        return at

    def expression(self) -> str:
        """A regular expression for texts of the form ' token token … ', for engines that have no automata."""

        def of(parts: list) -> str:
            out = ""
            for p in parts:
                if isinstance(p, str):
                    out += f"{p} "
                elif p[0] == "opt":
                    out += f"({of(p[1])})?"
                elif p[0] == "any":
                    out += f"([^ ]+ ){{{p[1]},{p[2]}}}"
                else:
                    out += "(" + "|".join(of(w) for w in p[1]) + ")"
            return out

        return " " + of(self.parts)


def find(words: list[str], automata: dict[str, Automaton], by_start: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """(license, first token, last token + 1): for each license its first match in a text."""
    found: dict[str, tuple[int, int]] = {}
    for i, w in enumerate(words):
        for name in by_start.get(w, ()):
            if name not in found and (end := automata[name].match_at(words, i)) >= 0:
                found[name] = (i, end)
    return [(name, a, b) for name, (a, b) in sorted(found.items())]


def compiled(templates: dict[str, str]) -> tuple[dict[str, Automaton], dict[str, list[str]]]:
    automata = {name: Automaton(t) for name, t in templates.items()}
    by_start: dict[str, list[str]] = {}
    for name, a in automata.items():
        for t in a.starts():
            if t is None:
                raise ValueError(f"{name} must begin with words")
            by_start.setdefault(t, []).append(name)
    return automata, by_start


def _scanner(templates: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, by_start = compiled(templates)
        for batch in batches:
            ids, names, firsts = [], [], []
            for a, b in slices(batch.column(1)):
                for i, text in enumerate(batch.column(1).slice(a, b - a).to_pylist(), a):
                    for name, first, _ in find(tokens(text), automata, by_start):
                        ids.append(i)
                        names.append(name)
                        firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(firsts, pa.int64())], names=["doc_id", "license_id", "first_token"])

    return scan


def _may_match(text: Column, templates: dict[str, str]) -> Column:
    anchors = sorted({a.anchor for a in compiled(templates)[0].values()})
    needed = [a for a in anchors if not any(b != a and b in a for b in anchors)]
    low = F.lower(text)
    out = F.lit(False)
    for a in needed:
        out = out | low.contains(a)
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, license_id, first_token: each license whose template a text holds, with the place of its first match.

    Null and empty texts hold none; very long texts are scanned whole.  Repeated rows give their matches each; a null id stays null; an empty table
    gives an empty one; other columns aren't read.  A text may match several templates.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where(_may_match(F.col("text"), templates)).mapInArrow(_scanner(templates), f"doc_id {kind}, license_id string, first_token bigint")


def oracle(templates: dict[str, str]) -> str:
    norm = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' '"
    automata, _ = compiled(templates)
    each = "\nUNION ALL\n".join(
        f"SELECT doc_id, '{name}' AS license_id, CAST(len(string_split(trim(t[1:strpos(t, regexp_extract(t, '{a.expression()}')) - 1]), ' ')) - CASE WHEN strpos(t, regexp_extract(t, '{a.expression()}')) = 1 THEN 1 ELSE 0 END AS BIGINT) AS first_token FROM n WHERE regexp_matches(t, '{a.expression()}')"
        for name, a in automata.items()
    )
    return f"WITH n AS MATERIALIZED (SELECT doc_id, {norm} AS t FROM documents)\n{each}"
