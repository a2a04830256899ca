"""License scans: a trained paragraph classifier in DataFrame functions.

Paragraphs are separated by blank lines; their wrapped lines are read as one. A paragraph is scored whole, line by line
and in word windows: word unigrams and bigrams are hashed to FEATURES places, and a sparse multinomial logistic
regression over them gives the probability of each licence family, of "unknown" and of "prose", which is no notice.
Licences that are no family here are examples of the unknown class: some train it, the others (HELD_OUT) are kept from
training and set the cutoffs together with held-out variants. A prediction stands only if a template of its family
confirms it: at least CONFIRM of the template's bigrams, weighted by how few licences have them, occur in the piece.
A paragraph with a piece that is a notice (its chance of being prose is under a cutoff) of which no family stands is
listed as unknown.

The training rows are the templates and other licences with deterministic variants, and sentences that only talk about
licences: the bound is their number times VARIANTS, independent of the input. The fitted weights are literals of the
plan, and a scan is one pass without a shuffle.

Every text is scanned. A piece is scored if it holds one of MARKS, without which nothing is taken for a notice of an
unknown licence, or if a template can be confirmed there, which is worked out from cheap to exact: without any word of
a cover (see gate_words) less than CONFIRM of every template can be there; then the bigrams of the text, then those of
the piece are compared with the templates.

Defined results: null and empty texts have no paragraphs; equal rows are scanned one by one; of equally sure pieces the
one that holds more of its template stands, then the first family by name; very long texts are scanned whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1024
VARIANTS = 12
CONFIRM = 0.5
#: Notices as their stewards word them, and short forms.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License 2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0",
        "This work is dedicated to the public domain",
    ],
    "proprietary": ["All rights reserved", "All rights reserved. No part of this publication may be reproduced without permission of the copyright holder"],
}
NEGATIVES = [
    "Her driving licence was renewed last week", "He took some poetic license with the story", "The copyright office opened at nine", "A license plate was found on the road",
    "They asked for permission to leave early", "The warranty of the machine ended in May", "Public transport and the domain of science", "Copyright law is a wide field of study",
    "The version of the report is final and released under embargo", "This work is hard and the terms of the contract are clear", "General public opinion of the software is good",
    "Under the terms of the lease you may not use this room", "The license was revoked by the city council", "The above notice was included in all letters", "free of charge to any person over sixty",
    "She lost her fishing license at the lake", "The pilot showed a valid licence to the inspector", "A licensed electrician repaired the old wiring", "The restaurant waited months for its liquor license",
    "Doctors must renew their medical license every five years", "The bar was licensed to sell beer until midnight", "The shop sells licensed toys of a film", "Poetic licence let him bend the rules of grammar",
    "The band fought over the copyright of their first song", "A court ruled that the copyright had expired", "The lecture on copyright drew a small crowd", "The novel is out of copyright in most countries",
    "The king would redistribute land among the farmers", "Taxes redistribute income from rich to poor", "The charity redistributed food to the shelters", "The river redistributes sand along the coast",
    "The car came with a warranty of three years", "He returned the phone while it was under warranty", "The police had no warrant to search the house", "The results warrant a closer look at the method",
    "The table by the window was reserved for guests", "She was quiet and reserved at the meeting", "Seats are reserved for members of the club", "The hotel reserved a room for the night",
    "The king ruled over a wide domain", "Mathematics was her domain and music his", "The function has a domain of all real numbers", "They registered a domain name for the site",
    "The children had permission to play outside", "The guard gave permission to enter the building", "Without permission nobody may leave the ship", "Smoking is not permitted in the museum",
    "Dogs are permitted on the beach in winter", "The law permitted trade with the islands", "The council granted permission for a new bridge", "The license plate was covered with mud",
    "Drivers without a licence pay a high fine", "The teacher asked about the license of the hunter", "The warranty on the roof ends in autumn", "His domain was the kitchen of the old hotel",
]
#: Notices of licences that are no family here; those of HELD_OUT only calibrate.
OTHERS = [
    "Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Licensed under the European Union Public Licence, version 1.2", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1", "Licensed under the Artistic License 2.0", "Licensed under the Microsoft Public License",
    "This work is licensed under the Open Data Commons Open Database License", "Use of this software is governed by the Business Source License",
    "Licensed under the Universal Permissive License, Version 1.0", "Distributed under the terms of the Python Software Foundation License", "Released under the zlib License", "Licensed under the W3C Software Notice and License",
    "This file is distributed under the University of Illinois Open Source License", "Distributed under the OpenSSL License", "Available under the Ruby License", "Licensed under the Elastic License 2.0", "This code is subject to the terms of the CeCILL license",
    "This library is distributed under the terms of the Open Software License version 3.0", "Released under the Do What The Fuck You Want To Public License", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: WTFPL",
    "You may redistribute this package under the same terms as Perl itself", "This documentation is distributed under the FreeBSD Documentation License", "The software may be used under the terms of the Vim license",
    "Redistribution and use of this package are permitted under the license in the file COPYING", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "See the LICENSE file for the license of this project", "This work is licensed under the Open Government Licence v3.0", "Licensed under the Solderpad Hardware License, Version 2.1", "Distributed under the terms of the Modified Apache style license of the project",
]
HELD_OUT = [
    "Distributed under the Boost Software License, Version 1.0", "Licensed under the Common Development and Distribution License", "This is free and unencumbered software released into the public domain",
    "SPDX-License-Identifier: ISC", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document", "Licensed under the Server Side Public License",
    "This work is licensed under the GNU Free Documentation License", "Licensed under the PostgreSQL License", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Academic Free License version 3.0",
]
FILLER = "a note on page the of our own project and its file here see also for more details in this text below today".split()
PLAIN = ("he she they it was were had said came went took made found water day night street door hand eyes city river field school table winter old young small large first last many some every "
    "never often then when while before after with into over from but and or than because year people time way back down").split()  # fmt: skip
COMMON = set("a all an and any are as at be by for from has have if in is it may no not of on or our shall should that the this to under with work you your "
    "charge conditions distributed except file following free general included international met modify part person public published received source subject terms use version without".split())  # fmt: skip
#: A piece that holds none of these is no notice of an unknown licence; templates are found without them.
MARKS = ("licen", "copyright", "redistribut", "domain", "warrant", "reserved", "permission", "permitted")
#: Words in a window; steps are half of that, so a notice of half a span lies whole in one window.
SPANS = (16, 32, 48, 72)
UNKNOWN, PROSE = "unknown", "prose"
FAMILIES = [*TEMPLATES, UNKNOWN, PROSE]
RESULT = ["doc_id", "n_paragraphs", "n_confirmed", "n_unknown", "families", "paragraphs"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9+]+"), "")


def _template_bigrams(text: str) -> list[str]:
    """Distinct; a literal of the plan, where the same in DataFrame functions would be worked out again for each row."""
    words = [w for w in re.split("[^a-z0-9+]+", text.lower()) if w]
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def bigram_weights() -> dict[str, float]:
    """Of each bigram of a template: one over the number of licences, families and others, that have it; a tenth of that
    where both words are common."""
    licences = [*TEMPLATES.values(), *([x] for x in (*OTHERS, *HELD_OUT))]
    holders = [{g for t in texts for g in _template_bigrams(t)} for texts in licences]
    plain = lambda g: 0.1 if all(w in COMMON or len(w) < 2 for w in g.split()) else 1.0
    return {g: plain(g) / sum(g in h for h in holders) for texts in TEMPLATES.values() for t in texts for g in _template_bigrams(t)}


def gate_words() -> list[str]:
    """Words without which every template lacks more than 1 - CONFIRM of its weight, chosen greedily, common ones last."""
    weights, chosen = bigram_weights(), set()
    templates = [_template_bigrams(t) for texts in TEMPLATES.values() for t in texts]
    cost = lambda w: 1000 if w in COMMON or len(w) < 2 else 1

    def open_(template: list[str]) -> bool:
        left = sum(weights[g] for g in template if not chosen & set(g.split()))
        return left >= CONFIRM * sum(weights[g] for g in template) - 1e-9

    while waiting := [t for t in templates if open_(t)]:
        gain: dict[str, float] = {}
        for t in waiting:
            total = sum(weights[g] for g in t)
            for g in t:
                if not chosen & set(g.split()):
                    for w in set(g.split()):
                        gain[w] = gain.get(w, 0.0) + weights[g] / total / cost(w)
        chosen.add(max(sorted(gain), key=gain.__getitem__))
    return sorted(chosen)


def _gate(low: Column) -> Column:
    """Whether lower-case text has a gate word: long ones anywhere, short ones by themselves."""
    words = gate_words()
    long, short = [w for w in words if len(w) > 4], [w for w in words if len(w) <= 4]
    own = [low.rlike(f"(?<![a-z0-9+])(?:{'|'.join(map(re.escape, short))})(?![a-z0-9+])")] if short else []
    return functools.reduce(lambda a, b: a | b, [*[F.contains(low, F.lit(w)) for w in long], *own])


def _once(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>")
    )


def _hashed(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)).cast("int")))


def training_rows(seed: int = 1) -> list[tuple[str, int, bool, bool]]:
    """(line, family, held out, of a licence that is held out whole): examples with words dropped and put around."""
    rng, rows = random.Random(seed), []
    unknown, prose = FAMILIES.index(UNKNOWN), FAMILIES.index(PROSE)
    examples = [(t, i) for i, f in enumerate(TEMPLATES) for t in TEMPLATES[f]] + [(t, unknown) for t in (*OTHERS, *HELD_OUT)] + [(t, prose) for t in NEGATIVES]
    for text, family in examples:
        words = text.split()
        for v in range(VARIANTS):
            kept = [w for w in words if v == 0 or rng.random() > 0.1]
            near = rng.choice((FILLER, PLAIN))
            around = [[rng.choice(near) for _ in range(rng.randrange(0, 6))] for _ in range(2)] if v > 1 else [[], []]
            rows.append((" ".join([*around[0], *kept, *around[1]]), family, v % 4 == 3 or text in HELD_OUT, text in HELD_OUT))
    for v in range(20 * VARIANTS):
        rows.append((" ".join(rng.choice((FILLER, PLAIN)[v % 2]) for _ in range(rng.randrange(3, 30))), prose, v % 4 == 3, False))
    return rows


class Classifier:
    """Weights, bias, temperature and cutoffs, fitted on the bounded training rows.

    accuracy: of held-out variants; notices: share of held-out rows, foreign licences too, rightly told from prose or as such.
    """

    def __init__(self, spark: SparkSession, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4):
        rows = training_rows()
        frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "id long, line string").coalesce(1)
        words = _words(F.col("line"))
        grams = dict(frame.select("id", _hashed(F.concat(words, _bigrams(words))).alias("g")).collect())
        x = np.zeros((len(rows), FEATURES), np.float32)
        for i, g in grams.items():
            x[i, g] = 1.0
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        y = np.array([f for _, f, *_ in rows])
        held, foreign = (np.array([r[i] for r in rows]) for i in (2, 3))
        weights, bias = np.zeros((FEATURES, len(FAMILIES))), np.zeros(len(FAMILIES))
        share = 1 / np.bincount(y[~held], minlength=len(FAMILIES))[y[~held]]
        share *= len(share) / share.sum()
        target = np.eye(len(FAMILIES))[y[~held]]
        for _ in range(epochs * 5):  # full-batch descent on balanced classes
            gap = (self._softmax(x[~held] @ weights + bias) - target) * share[:, None] / len(target)
            weights -= rate * 20 * (x[~held].T @ gap + decay * weights)
            bias -= rate * 20 * gap.sum(0)
        weights[np.abs(weights) < 0.02] = 0  # sparse
        logits = x[held] @ weights + bias
        loss = lambda t: -np.log(self._softmax(logits * t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
        self.temperature = min((0.5 * 1.25**i for i in range(12)), key=loss)
        chance = self._softmax(logits * self.temperature)
        self.accuracy = float((chance.argmax(1) == y[held])[~foreign[held]].mean())
        # Where the fewest held-out rows, those of foreign licences among them, are taken for a family wrongly or missed.
        top, family = chance.max(1), chance.argmax(1)
        right, named = (family == y[held]) & (family < len(TEMPLATES)), family < len(TEMPLATES)
        cutoffs = np.linspace(0.2, 0.95, 76)
        errors = [(named & ~right & (top >= c)).sum() + (right & (top < c)).sum() for c in cutoffs]
        self.cutoff = float(cutoffs[int(np.argmin(errors))])
        # The chance of being prose below which a row is a notice: the strictest that takes the fewest held-out rows wrongly.
        prose, notice = chance[:, FAMILIES.index(PROSE)], y[held] != FAMILIES.index(PROSE)
        bars = np.linspace(0.05, 0.95, 91)
        errors = np.array([(notice != (prose < c)).sum() for c in bars])
        self.prose = float(bars[int(np.argmin(errors))])
        self.notices = float(1 - errors.min() / held.sum())
        self.weights, self.bias = np.round(weights * self.temperature, 4), np.round(bias * self.temperature, 4)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


_fitted: dict[str, Classifier] = {}


def classifier(spark: SparkSession) -> Classifier:
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted[key] = Classifier(spark)
    return _fitted[key]


def _numbers(values, kind: str = "double") -> Column:
    return F.split(F.lit(",".join(f"{v:g}" for v in values)), ",").cast(f"array<{kind}>")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs; see RESULT. n_paragraphs counts all paragraphs that are not blank, n_confirmed
    those with a family that stands, n_unknown those that are notices of none.

    paragraphs: (first line of the paragraph from 0, family or "unknown", probability, share of the best template
    found), for the paragraphs that are notices: one entry for each family that stands, else one, whose probability is
    that of being a notice. The classifier is asked about whole paragraphs, their lines, and word windows at each of
    SPANS. A piece without MARKS that holds less than CONFIRM of every template is not scored.
    """
    model = classifier(docs.sparkSession)
    k = len(FAMILIES)
    weights, bias = _numbers(model.weights.T.reshape(-1)), _numbers(model.bias)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    by_family = [[_template_bigrams(t) for t in TEMPLATES.get(f, [])] for f in FAMILIES]
    strings = lambda x: F.array(*map(F.lit, x))
    weight = bigram_weights()
    total = lambda t: sum(weight[g] for g in t)
    entry = lambda t: F.struct(strings(t).alias("t"), _numbers([weight[g] / total(t) for g in t]).alias("w"))
    none = F.array().cast("array<struct<t:array<string>,w:array<double>>>")
    templates = F.array(*[F.array(*map(entry, ts)) if ts else none for ts in by_family])
    flat = F.array(*[entry(t) for ts in by_family for t in ts])
    part_of = lambda t, held: F.aggregate(F.zip_with(t["t"], t["w"], lambda g, w: F.when(F.array_contains(held, g), w).otherwise(0.0)), F.lit(0.0), lambda acc, w: acc + w)
    known_bigrams = strings(sorted({g for ts in by_family for t in ts for g in t}))

    def possible(words: Column) -> Column:
        """Whether some template has CONFIRM of its bigrams here: first those of any template, then each template of these."""
        have = lambda w: F.array_intersect(known_bigrams, _bigrams(w))
        enough = lambda h: F.exists(flat, lambda t: part_of(t, h) >= CONFIRM - 1e-9)
        return _once(words, lambda w: _once(have(w), lambda h: (F.size(h) > 0) & enough(h)))

    marked = lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in MARKS])
    asked = lambda words: marked(F.array_join(words, " ")) | possible(words)

    def pieces(p: Column) -> Column:
        windows = lambda words, span: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(span // 2)), lambda i: F.slice(words, i, span))
        parts = lambda words: F.concat(F.array(words), F.transform(F.split(p["text"], "\n", -1), _words), *[windows(words, span) for span in SPANS])
        found = lambda words: F.when(asked(words), F.filter(F.array_distinct(parts(words)), asked)).otherwise(F.array().cast("array<array<string>>"))
        return F.transform(_once(_words(p["text"]), found), lambda w: F.struct(p["line"].alias("line"), w.alias("words")))

    grammed = lambda p: F.struct(p["line"].alias("line"), _bigrams(p["words"]).alias("bigrams"), _hashed(F.concat(p["words"], _bigrams(p["words"]))).alias("grams"))

    def scored(p: Column) -> Column:
        norm = F.sqrt(F.greatest(F.size(p["grams"]), F.lit(1)))
        logits = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda f: F.get(bias, f) + F.aggregate(p["grams"], F.lit(0.0), lambda acc, g: acc + F.get(weights, f * FEATURES + g)) / norm,
        )
        return F.struct(p["line"].alias("line"), p["bigrams"].alias("bigrams"), logits.alias("logits"))

    def chosen(p: Column) -> Column:
        top = F.array_max(p["logits"])
        family = (F.array_position(p["logits"], top) - 1).cast("int")
        probability = 1 / F.aggregate(p["logits"], F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
        prose = F.exp(F.get(p["logits"], F.lit(FAMILIES.index(PROSE))) - top) * probability
        return F.struct(p["line"].alias("line"), p["bigrams"].alias("bigrams"), family.alias("family"), probability.alias("probability"), prose.alias("prose"))

    def confirmed(p: Column) -> Column:
        matches = F.transform(F.get(templates, p["family"]), lambda t: F.struct(part_of(t, p["bigrams"]).alias("share"), F.array_intersect(t["t"], p["bigrams"]).alias("held")))
        best = F.array_max(matches)
        found = F.coalesce(best["share"], F.lit(0.0))
        stands = (p["probability"] >= model.cutoff) & (found >= CONFIRM - 1e-9)
        family = F.when(stands, F.get(names, p["family"])).otherwise(F.when(p["prose"] < model.prose, F.lit(UNKNOWN)).otherwise(F.lit(PROSE)))
        return F.struct(
            p["line"].alias("line"), family.alias("family"), F.when(stands, p["probability"]).otherwise(1 - p["prose"]).alias("probability"), found.alias("template_share"),
            best["held"].alias("held"),
        )

    def settled(all_pieces: Column) -> Column:
        """Of a paragraph's pieces, the surest of each family; not those whose match is a part of another family's."""
        stand = F.filter(all_pieces, lambda p: ~p["family"].isin(UNKNOWN, PROSE))
        part = lambda p, q: (p["family"] != q["family"]) & (F.size(p["held"]) < F.size(q["held"])) & (F.size(F.array_except(p["held"], q["held"])) == 0)
        own = F.filter(stand, lambda p: ~F.exists(stand, lambda q: part(p, q)))
        same = lambda p, q: p["family"] == q["family"]
        ahead = lambda p, q: (q["probability"] > p["probability"]) | ((q["probability"] == p["probability"]) & (q["template_share"] > p["template_share"]))
        kept = F.filter(own, lambda p: ~F.exists(own, lambda q: same(p, q) & ahead(p, q)))
        plain = lambda p: F.struct(*[p[c].alias(c) for c in ("line", "family", "probability", "template_share")])
        # All of one line and "unknown", so the greatest is the surest.
        open_ = F.array_max(F.transform(F.filter(all_pieces, lambda p: p["family"] == UNKNOWN), plain))
        return F.when(F.size(kept) > 0, F.array_distinct(F.transform(kept, plain))).otherwise(F.array_compact(F.array(open_)))

    text = F.regexp_replace(F.col("text").cast("string"), "\r\n?", "\n")
    # A paragraph starts at a line with a word after a blank one; "line" counts the line breaks before it.
    blocks = F.split(text, "\n(?=[ \t]*\n)", -1)
    placed = F.aggregate(
        blocks, F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("out")),
        lambda acc, x: F.struct((acc["line"] + F.size(F.split(x, "\n", -1))).alias("line"), F.concat(acc["out"], F.array(F.struct((acc["line"] + F.when(F.startswith(x, F.lit("\n")) | x.rlike("^[ \t]+\n"), 1).otherwise(0)).alias("line"), x.alias("text")))).alias("out")),
        lambda acc: acc["out"],
    )
    worded = F.size(F.filter(blocks, lambda x: x.rlike("\\S"))).cast("long")
    column = F.when(_once(F.lower(text), lambda low: marked(low) | (_gate(low) & possible(_words(text)))), F.filter(F.transform(placed, pieces), lambda x: F.size(x) > 0)).otherwise(F.array().cast("array<array<struct<line:int,words:array<string>>>>"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNull(), 0).otherwise(worded).cast("long").alias("n"), column.alias("p"))
    each = lambda step: lambda own: F.transform(own, step)
    for step in (grammed, scored, chosen, confirmed):
        out = out.select("doc_id", "n", F.transform("p", each(step)).alias("p"))
    # Pieces meet those of their own paragraph only: a text of many notices costs in proportion to them.
    out = out.select("doc_id", "n", F.array_sort(F.flatten(F.transform("p", settled))).alias("p"))
    stands = lambda p: p["family"] != UNKNOWN
    known = F.size(F.array_distinct(F.transform(F.filter("p", stands), lambda p: p["line"]))).cast("long")
    open_ = F.size(F.filter("p", lambda p: ~stands(p))).cast("long")
    return out.select(
        "doc_id", F.col("n").alias("n_paragraphs"), known.alias("n_confirmed"), open_.alias("n_unknown"),
        F.array_sort(F.array_distinct(F.transform(F.filter("p", stands), lambda p: p["family"]))).alias("families"), F.col("p").alias("paragraphs"),
    )
