"""License scans: phrases, and templates whose optional and replaceable regions become token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Phrases of the scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Templates by label. <<optional>>..<<end>> may be absent; <<any:a-b>> stands for a to b words of any kind.
TEMPLATES = {
    "notice-mit": "<<optional>>this <<any:1-3>> is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> <<optional>>distributed<<end>> under <<optional>>the terms of<<end>> the mit license",
    "notice-apache-2.0": "licensed under the apache license version 2 0 <<optional>>the license you may not use this file except in compliance with the license<<end>>",
    "notice-gpl": "licensed under the gnu <<any:0-1>> general public license <<optional>>either<<end>> version <<any:1-2>>",
    "notice-cc-by-nc": "licensed under <<optional>>a creative commons<<end>> <<optional>>the<<end>> cc by nc <<any:1-2>>",
    "notice-gpl-later": "this <<any:1-3>> is free software you can redistribute it and or modify it under the terms of the gnu <<any:0-1>> general public license as published by the free software foundation either version <<any:1-2>> of the license or at your option any later version",
    "notice-mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any:1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "text-isc": "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:1-12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:1-12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "text-zlib": "this software is provided as is without any express or implied warranty in no event will <<any:1-12>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any:0-1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any:0-1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any:0-1>> this notice may not be removed or altered from any source distribution",
    "text-boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "text-unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}

#: The parts of the BSD licenses, of which each variant is made.
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "<<any:0-1>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<any:1-12>>"
_BSD_NAMES = "<<any:0-1>> neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by <<any:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES |= {
    "text-bsd-2": f"{_BSD_GRANT} {_BSD_WARRANTY}",
    "text-bsd-3": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}",
    "text-bsd-4": f"{_BSD_GRANT} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_WARRANTY}",
}

_FOLD = bytearray(range(256))
for _b in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
    _FOLD[_b] = 32
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32
#: A-Z to a-z; every other ASCII byte that is no letter or digit to a blank.
FOLD = bytes(_FOLD)


def template_of(text: str) -> str:
    """A template whose whole wording is mandatory, from a license's text: how longer licenses become parameters."""
    return b" ".join(text.encode().translate(FOLD).split()).decode()


class Automaton:
    """A template as a line of steps; optional regions are jumps over steps. Runs over words from a given start."""

    def __init__(self, template: str):
        parts = re.findall(r"<<(optional|end|any:\d+-\d+)>>|([^\s<>]+)", template)
        self.words: list[bytes | None] = []
        self.jumps: list[set[int]] = []
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]
        for mark, word in parts:
            if word:
                self._add(word.encode())
                if not opened:
                    runs[-1].append(word.encode())
                continue
            if not opened:
                runs.append([])
            if mark == "optional":
                opened.append(len(self.words))
            elif mark == "end":
                start = opened.pop()
                self._jump(start, len(self.words))
                if not opened:
                    runs.append([])
            else:
                least, most = map(int, mark[4:].split("-"))
                for k in range(most):
                    self._add(None)
                    if k >= least:
                        self._jump(len(self.words) - 1, len(self.words))
        if opened:
            raise ValueError("an optional region is not closed")
        if not any(runs):
            raise ValueError("a template needs wording that is mandatory")
        #: The longest run of mandatory words: every accepted text has it.
        self.anchor = b" " + b" ".join(max(runs, key=lambda r: len(b" ".join(r)))) + b" "

    def _add(self, word: bytes | None) -> None:
        self.words.append(word)

    def _jump(self, start: int, to: int) -> None:
        while len(self.jumps) <= len(self.words):
            self.jumps.append(set())
        self.jumps[start].add(to)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            at = todo.pop()
            for to in self.jumps[at] if at < len(self.jumps) else ():
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def found(self, words: list[bytes]) -> bool:
        """Whether some stretch of the words is accepted: its mandatory wording stands there exactly."""
        final, live = len(self.words), set()
        for word in words:
            live = self._closed(live | {0})
            live = {s + 1 for s in live if s < final and (self.words[s] is None or self.words[s] == word)}
            if final in self._closed(set(live)):
                return True
        return False


def scan_text(body: bytes, automata: dict[str, Automaton], phrases: dict[bytes, str]) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text.

    score: 1 where a template is accepted, 0.6 where only phrases stand, else 0.
    """
    words = body.translate(FOLD).split()
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        at = line.find(phrase)
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = line.find(phrase, at + 1)
    own = {label for label, a in automata.items() if a.anchor in line and a.found(words)}
    first, last = ((line.count(b" ", 0, at) for at in (min(places), max(places))) if places else (None, None))
    score = 1.0 if own else 0.6 if labels else 0.0
    return len(words), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | own)), score


def scan(docs: DataFrame, keep: list[str] | None = None, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """The columns `keep` of docs with what scan_text() finds in each whole `text` (null: empty, no words).

    One pass without a shuffle. The columns that are kept may have any names, those of the result too.
    """
    keep = ["doc_id"] if keep is None else keep
    rows, (text, *kept) = common.by_place(docs, "text", *keep)
    templates = TEMPLATES if templates is None else templates
    sought = {b" " + p.encode() + b" ": label for p, label in (PHRASES if phrases is None else phrases).items()}
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: Automaton(t) for label, t in templates.items()}
        for batch in common.small_batches(batches, "body"):
            found = list(zip(*(scan_text(b, automata, sought) for b in batch.column("body").to_pylist()), strict=True))
            out = [batch.column(c) for c in kept] + [pa.array(list(v), k) for v, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *names])

    schema = common.fields(rows, kept)
    for name, kind in zip(names, ["long"] * 4 + ["string"] * 2 + ["double"], strict=True):
        schema = schema.add(name, kind)
    return common.bound_batches(rows.select(*kept, common.text_bytes(text).alias("body"))).mapInArrow(run, schema).toDF(*keep, *names)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, phrases and accepted templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
