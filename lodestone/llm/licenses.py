"""License scans by a trained paragraph classifier, in Spark functions alone.

The classifier is a multinomial logistic regression over the sparse word uni- and bigrams
of licence notices. It is trained in numpy on the driver from the notice templates below,
variants of them and running text of four languages that isn't a notice; its weights are a
small table, whose size the templates bound. An n-gram is a feature only if it holds one
of the cue stems, and only a paragraph (a line, or lines up to a blank one, joined) with a
cue is looked at: texts without one cost a few substring searches. Temperature and floor
are calibrated on notices and texts that aren't made from the training templates; a
paragraph under the floor is of unknown licence. A family counts as confirmed if the words
of one of its templates are there and no other family's template is closer.

All is one projection over the documents: nothing is joined or shuffled.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import _let

# Common licence notices by family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is distributed under the terms of the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "all-rights-reserved": ("All rights reserved.", "Copyright by the author, all rights reserved.", "No part of this publication may be reproduced without permission."),
}
# Words too common to be a feature on their own.
COMMON = frozenset("a all and any are as be by can charge code copy deal except file following form free from general in is it later may met no not of on or part person program project provided public source subject terms that the this to under use v version with without work you 2 3 4 0 2.0 3.0 4.0".split())
# Stems of words that licence notices have and running text seldom has.
CUES = ("licen", "copyright", "spdx", "gnu", "gpl", "apache", "mozilla", "mpl-", "bsd", "isc ", "epl-", "eclipse", "creative", "attribution", "noncommercial", "sharealike", "cc by", "cc-by", "redistribut", "permission", "permitted", "reserved", "granted", "domain", "warrant")
# Text of no family, in four languages, with such words.
_OTHER = (
    "See the license file for the terms.", "Used under license from the owner.", "This software comes with a license of its own.",
    "The document is licensed separately.", "Copyright notices must stay.", "We published the conditions of the contest.",
    "The driver renewed the license of the car.", "She asked for permission to leave the room early.", "The table was reserved for the members of the club.",
    "The apache helicopter landed near the village.", "The creative director left the agency in spring.", "The warranty of the washing machine has expired.",
    "The king granted the town the right to hold a market.", "A copyright dispute went on in court for years.", "Smoking is not permitted in the building.",
    "Without permission no one may enter the garden, and permission is seldom given.", "They had the permission of the court to sell the house.", "The reserved man spoke little and kept a reserved seat.",
    "The license was valid for one year and the license fee was high.", "An expired license must be renewed before the term of use ends.", "The licensed trade in the city pays a license tax.", "He reserved a room and reserved judgment.",
    "A total eclipse of the sun was seen in the public park.", "The gnu is an antelope of the open plains.", "All rights of way are reserved for walkers and riders.",
    "Die Software wird mit einer license ausgeliefert.", "Mit der Copyright-Frage befasst sich das Gericht in Wien.", "Der Fahrer mit der License wartet mit den anderen.",
    "Die Apache fuhr mit dem Zug und mit dem Bus.", "Das Permission-System ist mit dem Server verbunden.", "Der Tisch ist reserved und die Stühle auch.", "Die License gilt nicht für den Copyright-Vermerk.",
    "La licence de pêche est valable un an.", "Elle a une licence de lettres et une licence de droit.", "L'attribution des logements est décidée par la mairie.",
    "Il a demandé la permission de sortir avant midi.", "Le club a délivré une licence au joueur.", "Le domaine public maritime est protégé.", "Avec la permission du juge, la permission est prolongée.", "La licence professionnelle et la licence sportive diffèrent.",
    "La licencia de conducir caduca en mayo.", "El licenciado pidió una licencia para la obra.", "El ayuntamiento concede la licencia de apertura.", "El dominio de la lengua es importante.",
)
_PLAIN = "the river is wide and people of town use it to work in all forms with no charge for any person under this plan it may be part of general terms from source to sea der die und mit von le la les des est que el los las con por".split()
# Notices that the classifier isn't trained on; temperature and floor come from them.
CALIBRATION = (
    ("apache-2.0", "The code is available under Apache License 2.0, see below."), ("apache-2.0", "Distributed under the terms of the Apache-2.0 license"),
    ("mit", "This package is MIT licensed."), ("mit", "Copyright 2019 the authors. Code released under the MIT license, see LICENSE."),
    ("gpl", "You may copy it under the GNU General Public License version 2."), ("gpl", "This plugin is GPL software, licensed under the GPL."),
    ("lgpl", "The library is covered by the GNU Lesser General Public License v3."), ("lgpl", "Distributed under the LGPL license."),
    ("agpl", "The server is available under the GNU Affero General Public License."), ("agpl", "This project is AGPL licensed."),
    ("bsd", "This code is distributed under a BSD license."), ("bsd", "Redistributions in binary form must reproduce the above; redistribution and use in source and binary forms are permitted."),
    ("isc", "The module is available under the ISC license."), ("epl-2.0", "The plugin is covered by the Eclipse Public License."),
    ("mpl-2.0", "The files are covered by the Mozilla Public License."), ("mpl-2.0", "Covered code under the MPL-2.0 license"),
    ("unlicense", "This work is given to the public domain under the Unlicense."),
    ("cc-by", "The text is available under a Creative Commons Attribution 4.0 license."), ("cc-by", "Photos: CC BY 4.0"),
    ("cc-by-sa", "Text under CC BY-SA 4.0"), ("cc-by-sa", "Available under the Creative Commons Attribution ShareAlike license."),
    ("cc-by-nc", "Figures under CC BY-NC 4.0"), ("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 applies."),
    ("all-rights-reserved", "Copyright 2021 Some Press. All rights reserved."), ("all-rights-reserved", "All rights reserved by the publisher."),
    ("unknown", "He lost his license after the race."), ("unknown", "The seats are reserved and smoking is not permitted."),
    ("unknown", "Permission of the farmer is needed to cross the field."), ("unknown", "A creative idea was granted a prize."),
    ("unknown", "Der Spieler kam mit der Lizenz und mit dem Trainer, die License fehlt."), ("unknown", "Das Copyright liegt mit allen Rechten beim Verlag."),
    ("unknown", "La licence du joueur est suspendue."), ("unknown", "L'attribution du prix et la permission du maire."),
    ("unknown", "La licencia de obras fue denegada."), ("unknown", "License terms are in another document."),
)
_TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
CONFIRM = 0.6


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.translate({c: c + 32 for c in range(65, 91)}))


def ngrams(words: list[str]) -> set[str]:
    """Unigrams that aren't common and bigrams with a word that isn't, if a cue is in them."""
    single = {w for w in words if w not in COMMON}
    double = {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in COMMON or b not in COMMON}
    return {g for g in single | double if any(c in g for c in CUES)}


class Model:
    """Weights by n-gram and family, calibrated by a temperature and a floor."""

    def __init__(self, seed: int = 20, variants: int = 24, steps: int = 400):
        rng = np.random.default_rng(seed)
        self.families = [*TEMPLATES, "unknown"]
        texts, labels = [], []
        for k, name in enumerate(self.families):
            for t in TEMPLATES.get(name, _OTHER):
                base = tokens(t)
                for v in range(variants):
                    # The notice itself, or one that lost words and stands among others.
                    kept = base if v == 0 else [w for w in base if rng.random() > 0.1]
                    front, back = rng.integers(0, 8, 2) * (v % 2)
                    texts.append([*rng.choice(_PLAIN, front), *kept, *rng.choice(_PLAIN, back)])
                    labels.append(k)
        self.templates = [(name, sorted(set(tokens(t)))) for name, ts in TEMPLATES.items() for t in ts]
        self.template_pairs = [(name, sorted({" ".join(p) for p in zip(tokens(t), tokens(t)[1:])})) for name, ts in TEMPLATES.items() for t in ts]
        vocabulary = {g for ts in (*TEMPLATES.values(), _OTHER) for t in ts for g in ngrams(tokens(t))}
        self.vocabulary = sorted(vocabulary)
        self.number = {g: k for k, g in enumerate(self.vocabulary)}
        x, y = self._rows(texts), np.eye(len(self.families))[labels]
        # Texts without a feature are never looked at. Families count alike, whatever their templates' number.
        some = x.any(axis=1)
        x, y = x[some], y[some]
        share = (y / y.sum(axis=0)).sum(axis=1, keepdims=True) / y.shape[1]
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        for _ in range(steps):
            d = (_softmax(x @ w + b) - y) * share
            w -= 8.0 * (x.T @ d + 1e-4 * w)
            b -= 8.0 * d.sum(axis=0)
        truth = np.array([self.families.index(f) for f, _ in CALIBRATION])
        logits = self._rows([tokens(t) for _, t in CALIBRATION]) @ w + b
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.3, 8, 60), key=loss))
        p = _softmax(logits / self.temperature)
        guess, known = p.argmax(axis=1), p.argmax(axis=1) < len(TEMPLATES)
        # Right notices above the floor count for it, wrong ones twice against it.
        worth = lambda f: ((guess == truth) & known & (p.max(axis=1) >= f)).sum() - 2 * ((guess != truth) & known & (p.max(axis=1) >= f)).sum()
        floors = np.linspace(0.3, 0.95, 131)
        best = floors[[worth(f) == max(map(worth, floors)) for f in floors]]
        self.floor = float((best[0] + best[-1]) / 2)
        self.weights, self.bias = w / self.temperature, b / self.temperature
        self.accuracy = float((np.where(known & (p.max(axis=1) >= self.floor), guess, len(TEMPLATES)) == truth).mean())

    def _rows(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.number)))
        for r, t in enumerate(texts):
            for g in ngrams(t):
                if g in self.number:
                    x[r, self.number[g]] = 1
        return x


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model()


def _fixed(value, kind: str) -> Column:
    """A nested list as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _cue(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(_any([F.contains(low, F.lit(c)) for c in CUES]), F.lit(False))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for c in parts[1:]:
        out = out | c
    return out


def _judge(text: Column, several: Column, model: Model) -> Column:
    """What the model says of a paragraph as a struct; null if it has no feature."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(_TOKEN), F.lit(0))
    vocabulary, weights = _fixed(model.vocabulary, "array<string>"), _fixed(model.weights.tolist(), "array<array<double>>")
    adjacent = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1)))).otherwise(F.array().cast("array<string>"))
    of = lambda c, templates: F.array_intersect(c, _fixed(sorted({w for _, ws in templates for w in ws}), "array<string>"))
    share = lambda seen, ws: F.size(F.array_intersect(seen, _fixed(ws, "array<string>"))) / F.lit(float(len(ws)))
    closest = lambda seen, templates: F.array(*[F.greatest(F.lit(0.0), *[share(seen, ws) for f, ws in templates if f == name and ws]) for name in TEMPLATES])

    def score(found: Column, w: Column, pairs: Column) -> Column:
        add = lambda z, g: F.zip_with(z, F.element_at(weights, F.array_position(vocabulary, g).cast("int")), lambda a, b: a + b)
        z = F.aggregate(found, _fixed(model.bias.tolist(), "array<double>"), add)
        # Long paragraphs have many words of any template: theirs are compared by pairs.
        near = F.when(several, _let(of(pairs, model.template_pairs), lambda s: closest(s, model.template_pairs))).otherwise(_let(of(w, model.templates), lambda s: closest(s, model.templates)))
        return F.when(F.size(found) > 0, F.struct(z.alias("z"), near.alias("near")))

    return _let(words, lambda w: _let(adjacent(w), lambda p: _let(F.array_intersect(F.concat(w, p), vocabulary), lambda found: score(found, w, p))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, paragraphs: bool = False) -> DataFrame:
    """(doc_id, line, last_line, family, probability, similarity, template_family,
    confirmed): one row per line (from 0) that has an n-gram of the vocabulary, last_line
    being line. family is "unknown" where no family reaches the floor; similarity is the
    share of a template's words that the line has, the largest of any template of the family
    (of all, if that is unknown); template_family: the family with the closest template, the
    predicted one if none is closer; confirmed: they agree, and similarity is at least
    CONFIRM.

    With ``paragraphs`` the paragraphs of several lines, up to a blank one, have rows of
    their own, from line to last_line: a wrapped notice is one text there. As a long one has
    many words, its similarity is the share of a template's pairs of adjacent words.

    Null and empty texts give no rows, nor does an empty table. Rows with a null or a
    repeated id give rows of their own. Other columns are ignored."""
    model = model or trained()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).filter(_cue(F.replace(text, F.lit("\n"), F.lit(" "))))
    part = lambda line, last, t: F.struct(line.cast("int").alias("line"), last.cast("int").alias("last_line"), t.alias("text"))

    def parts(lines: Column) -> Column:
        single = F.filter(F.transform(lines, lambda t, i: part(i, i, t)), lambda x: _cue(x["text"]))
        if not paragraphs:
            return single
        full = lambda i: F.get(lines, i).rlike(r"\S")
        edge = lambda by: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: full(i) & ~F.coalesce(full(i + by), F.lit(False)))
        blocks = F.filter(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("z")), lambda x: x["z"] > x["a"])
        joined = F.transform(blocks, lambda x: part(x["a"], x["z"], F.array_join(F.slice(lines, x["a"] + 1, x["z"] - x["a"] + 1), " ")))
        return F.concat(single, F.filter(joined, lambda x: _cue(x["text"])))

    found = rows.select("doc_id", F.explode(_let(F.split("text", "\n"), parts)).alias("p"))
    # Exploded, as no filter then moves below what makes the struct and makes it twice.
    judged = F.array(_judge(F.col("p.text"), F.col("p.last_line") > F.col("p.line"), model))
    scored = found.select("doc_id", "p.line", "p.last_line", F.explode(F.filter(judged, lambda x: x.isNotNull())).alias("r"))
    scored = scored.select("doc_id", "line", "last_line", "r.z", "r.near")
    top = F.array_max("z")
    probability = 1 / F.aggregate(F.transform("z", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    scored = scored.select("*", F.array_position("z", top).cast("int").alias("at"), probability.alias("probability"), F.array_max("near").alias("most"))
    known = (F.col("at") <= len(TEMPLATES)) & (F.col("probability") >= model.floor)
    own = F.try_element_at("near", F.col("at"))
    names = F.lit(list(TEMPLATES))
    family = F.when(known, F.try_element_at(names, F.col("at"))).otherwise("unknown")
    agrees = known & (own >= F.col("most"))
    return scored.select(
        "doc_id", "line", "last_line", family.alias("family"), "probability", F.when(known, own).otherwise(F.col("most")).alias("similarity"),
        F.when(agrees, family).otherwise(F.element_at(names, F.array_position("near", F.col("most")).cast("int"))).alias("template_family"),
        (agrees & (own >= CONFIRM)).alias("confirmed"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), paragraphs=True)
