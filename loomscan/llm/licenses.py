"""Licence scan with a positional rare-token index over licence templates.

Templates are the clauses of licence texts and notices. Document counts of all template words give their IDF. A template
is filed under the highest-IDF words of its mandatory key phrase: a file's words are looked up from the rarest on, each
hit proposes (template, relative position), and the key phrase must stand there word for word. The template's other
words are intersected by relative position: each must stand at its place or at most SHIFT words off, so that inserted or
missing words elsewhere do not move a clause out of reach; enough of them make a hit. Short phrases are templates all of
whose words are mandatory.

Results: null and empty texts have no words and no labels; a word may serve several templates; repeated places of one
template all count; extra columns are passed through, one named as an output is replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import add_columns, as_bytes, ascii_words

#: Phrase, label. Every word is mandatory.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Label and clause (public licence wording), its mandatory key phrase in brackets.
CLAUSES = """
mit: [permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files
mit: to deal in the software without restriction including without limitation [the rights to use copy modify merge publish distribute sublicense and or sell copies of the software]
mit: [the above copyright notice and this permission notice shall be included in all copies] or substantial portions of the software
bsd: [redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met
bsd: [redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer
bsd: [redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3: neither the name of the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software] without specific prior written permission
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and [this permission notice appear in all copies]
isc: permission to use copy [modify and or distribute this software] for any purpose with or without fee is hereby granted
zlib: [in no event will the authors be held liable] for any damages arising from the use of this software
zlib: [the origin of this software must not be misrepresented] you must not claim that you wrote the original software
zlib: [altered source versions must be plainly marked as such] and must not be misrepresented as being the original software
boost: [boost software license] version 1 0
unlicense: this is free and [unencumbered software released] into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software [either in source code form or as a compiled binary]
mpl: this source code form is subject to the terms of the [mozilla public license]
gpl: this program is free software [you can redistribute it and or modify it under the terms of the gnu general public license] as published by the free software foundation
lgpl: you should have received a copy of the [gnu lesser general public license]
agpl: you should have received a copy of the [gnu affero general public license]
mpl: if a copy of the mpl was not distributed with this file [you can obtain one at] https mozilla org mpl 2 0
mpl: [covered software is provided under this license on an as is basis] without warranty of any kind either expressed implied or statutory
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but [changing it is not allowed]
gpl: the licenses for most software and other practical works are designed to take away [your freedom to share and change the works]
gpl: [you may convey verbatim copies of the program s source code] as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice
gpl: you may convey a covered work in object code form [provided that you also convey the machine readable corresponding source] under the terms of this license
gpl: this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the [gnu general public license] for more details
lgpl: this version of the [gnu lesser general public license incorporates the terms and conditions of version 3] of the gnu general public license
lgpl: you may convey a combined work under terms of your choice that taken together effectively do not restrict [modification of the portions of the library contained in the combined work]
lgpl: this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation
agpl: if you modify the program your modified version must prominently offer [all users interacting with it remotely through a computer network] an opportunity to receive the corresponding source of your version
agpl: the [gnu affero general public license] is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
epl: the accompanying program is provided under the terms of this [eclipse public license] agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl: the contents of this file are subject to the terms of the [common development and distribution license] the license you may not use this file except in compliance with the license
artistic: everyone is permitted to copy and distribute verbatim copies of [this license document but changing it is not allowed preamble this license establishes the terms] under which a given free software package may be copied modified distributed and or redistributed
artistic: this package is free software you can redistribute it and or modify it under the terms of the [artistic license]
ofl: this font software is licensed under the [sil open font license] version 1 1
ofl: neither the font software nor any of its individual components in original or modified versions [may be sold by itself]
sspl: if you make the functionality of the program or a modified version available to third parties as a service [you must make the service source code available via network download] to everyone at no charge under the terms of this license
eupl: licensed under the [eupl] version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and [changing it is allowed as long as the name is changed]
ms-pl: this license governs use of the accompanying software [if you use the software you accept this license] if you do not accept the license do not use the software
psf: this license agreement is between the [python software foundation] psf and the individual or organization licensee accessing and otherwise using this software
apache: [grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license] to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works
apache: unless required by applicable law or agreed to in writing software distributed under the license is [distributed on an as is basis without warranties or conditions of any kind] either express or implied
apache: you must give any other recipients of the work or derivative works [a copy of this license]
mit: the software is provided as is without warranty of any kind express or implied including but not limited to the [warranties of merchantability fitness for a particular purpose and noninfringement]
bsd: this software is provided by the copyright holders and contributors as is and [any express or implied warranties] including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
cc0: [to the extent possible under law] the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work
cc-by-sa: [if you remix transform or build upon the material you must distribute your contributions under the same license] as the original
cc-by-nc: [you may not use the material for commercial purposes]
apache: you may obtain a copy of the license at http www [apache org licenses license 2 0]
apache: [you may not use this file except in compliance with the license]
cc-by-nc: [cc by nc]
cc-by-sa: [cc by sa]
cc-by-nd: [cc by nd]
cc-by: [creative commons attribution]
cc0: [cc0 1 0 universal]
"""
#: How far from its place a word of a clause may stand.
SHIFT = 3
#: Share of a template's words that must stand at their places.
ENOUGH = 0.7
#: Rarest words of a long template under which it is filed.
RARE = 3
FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"), ("labels", "array<string>"), ("score", "double"), ("hits", "array<struct<label:string,start:long,words:long,share:double>>")]


def templates() -> list[dict]:
    """Words, label, first key word, number of key words, and whether it is a base phrase, of every template."""
    out = [{"words": p.split(), "label": label, "at": 0, "key": len(p.split()), "base": True} for p, label in PHRASES]
    for line in CLAUSES.strip().split("\n"):
        label, _, clause = line.partition(": ")
        before, _, rest = clause.partition("[")
        key, _, after = rest.partition("]")
        out.append({"words": [*before.split(), *key.split(), *after.split()], "label": label, "at": len(before.split()), "key": len(key.split()), "base": False})
    return out


def vocabulary() -> list[bytes]:
    return sorted({w.encode() for t in templates() for w in t["words"]})


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): documents that have a template word; at most one row for each word of the vocabulary."""
    vocab = frozenset(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = dict.fromkeys(sorted(vocab), 0)
        for b in batches:
            for t in as_bytes(b.column(0)):
                for w in vocab.intersection(ascii_words(t)):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count]), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Templates filed by their rarest words."""

    def __init__(self, count: dict[bytes, int]):
        self.code = {w: i for i, w in enumerate(vocabulary())}
        self.rarity = np.array([count.get(w, 0) for w in self.code])
        self.filed: dict[int, list] = {}  # word: (template, its places in it)
        self.templates = []
        for number, t in enumerate(templates()):
            codes = np.array([self.code[w.encode()] for w in t["words"]])
            key = range(t["at"], t["at"] + t["key"])
            self.templates.append({"codes": codes, "label": t["label"], "key": key, "base": t["base"]})
            mandatory = sorted({int(codes[i]) for i in key}, key=lambda c: (self.rarity[c], c))  # each of these stands in a hit
            for c in mandatory[: 1 if len(key) <= 4 else RARE]:
                self.filed.setdefault(c, []).append((number, np.array([i for i in key if codes[i] == c])))

    def scan(self, words: list[bytes]) -> list[tuple]:
        """(template, start, share) of all hits."""
        found = np.fromiter(map(self.code.get, words, repeat(-1)), np.int32, len(words))
        known = np.unique(found[found >= 0])
        out: dict[tuple, float] = {}
        for c in sorted((int(c) for c in known if int(c) in self.filed), key=lambda c: (self.rarity[c], c)):
            places = np.flatnonzero(found == c)
            for number, own in self.filed[c]:
                t = self.templates[number]
                start = np.unique((places[:, None] - own[None, :]).ravel())
                lo, hi = start + t["key"][0], start + t["key"][-1]
                start = start[(lo >= 0) & (hi < len(found))]
                for i in t["key"]:  # mandatory words, each at its place
                    start = start[found[start + i] == t["codes"][i]]
                for s in start.tolist():
                    if (number, s) not in out:
                        out[number, s] = self.share(found, s, t["codes"])
        return sorted((n, s, share) for (n, s), share in out.items() if share >= ENOUGH)

    @staticmethod
    def share(found: np.ndarray, start: int, codes: np.ndarray) -> float:
        """Share of a template's words that stand at most SHIFT words off their places."""
        hit = np.zeros(len(codes), bool)
        for d in range(-SHIFT, SHIFT + 1):
            a, b = max(start + d, 0), min(start + d + len(codes), len(found))
            if a < b:
                own = slice(a - start - d, b - start - d)
                hit[own] |= found[a:b] == codes[own]
        return float(hit.sum()) / len(codes)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts' licence places and labels; score is the best share of a template found, 0 without any."""
    count = {r["word"].encode(): r["n"] for r in document_counts(df, text).collect()}  # one row for each template word

    def make():
        index = Index(count)

        def fn(column: pa.Array) -> list:
            out: list[list] = [[] for _ in FIELDS]
            for t in as_bytes(column):
                words = ascii_words(t)
                hits = index.scan(words)
                base = [(s, index.templates[n]["label"]) for n, s, _ in hits if index.templates[n]["base"]]
                row = (
                    len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
                    sorted({x for _, x in base}), sorted({index.templates[n]["label"] for n, *_ in hits}), max((x for *_, x in hits), default=0.0),
                    [{"label": index.templates[n]["label"], "start": s, "words": len(index.templates[n]["codes"]), "share": x} for n, s, x in hits],
                )
                for column_, v in zip(out, row, strict=True):
                    column_.append(v)
            return out

        return fn

    return add_columns(df, text, FIELDS, make)
