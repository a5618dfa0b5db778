"""Licence scan: a trained paragraph classifier, confirmed by templates.

A text is cut into units with their offsets: the sentences of every line, and
the sentences of its paragraphs that run over line ends (a line end within a
sentence counts as a blank; an empty line ends a paragraph). Signs between
words don't count, so comment marks don't either. A unit that holds a cue word
is judged: its distinct word 1- and 2-grams are hashed into a sparse vector, a
multinomial logistic regression over the licence families and an unknown class
gives probabilities, and the prediction counts if it isn't unknown, its
calibrated probability reaches the threshold, and the unit holds the words of
one of the family's templates (all but the commonest of a short one, CONFIRM
of a long one). Every template has a cue word, so units without cues are no
candidates. A sentence over line ends counts where none of its lines does.

The model is trained here, on the driver and once per process, from variants
of the templates (words dropped, cut ends, words of other text added) and from
sentences that only sound alike; no corpus row is used. The temperature and
the threshold are fitted on variants that were not trained on. Scanning uses
DataFrame functions only; the weights are a literal of fixed size.

Null and empty texts have no licences. Texts of any length are read whole, and
work is linear in their units. Repeated rows are judged each; an empty table
gives no rows; further columns don't matter.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import ascii_lower, let, walked

#: Notices by which licence families are known.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx license identifier agpl 3.0",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "see the license for the specific language governing permissions and limitations under the license",
        "distributed under the apache license 2.0",
        "available under the apache license 2.0",
        "spdx license identifier apache 2.0",
    ),
    "bsd": (
        "released under the bsd license",
        "licensed under the 3 clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "distributed under the bsd license",
        "available under the bsd license",
        "use of this source code is governed by a bsd style license",
        "spdx license identifier bsd 3 clause",
    ),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0"),
    "cc0": (
        "released into the public domain",
        "this work is dedicated to the public domain under the cc0 license",
        "this is free and unencumbered software released into the public domain",
        "spdx license identifier cc0 1.0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu gpl version 2 or later",
        "licensed under the gpl license",
        "licensed under the gplv3",
        "distributed under the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 2.0",
    ),
    "isc": (
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "spdx license identifier isc",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "spdx license identifier lgpl 2.1",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "distributed under the mit license",
        "available under the mit license",
        "use of this code is governed by the mit license",
        "spdx license identifier mit",
    ),
    "mpl": (
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org mpl",
        "spdx license identifier mpl 2.0",
    ),
    "proprietary": ("copyright all rights reserved", "this software is proprietary and confidential and may not be used without a license"),
}

#: Sentences that hold cue words and are no licence notices.
OTHER = (
    "he lost his driving license last year after the accident",
    "the city granted the bar a license to sell beer",
    "she has a fishing license and a small boat",
    "the court heard a copyright case about the song",
    "copyright law protects authors and their heirs",
    "the warranty covers parts for two years",
    "the mit campus is on the river in cambridge",
    "apache helicopters flew over the base",
    "the general public license fee for television went up",
    "a license plate was found near the road",
    "they asked for permission to use the hall for the party",
    "the public domain of the king was divided among his sons",
    "the free software foundation held a meeting in boston",
    "what license should i choose for my project",
    "the wealth was redistributed among the people",
    "the agency may revoke the license of a doctor",
    "public opinion on the version of the law was divided",
    "the museum bought the rights to the work and reserved the hall",
    "students of mit wrote the program in a week",
    "the mozilla foundation released a new version of the browser",
    "the apache web server runs on most of these machines",
    "software is provided to all schools of the district without charge",
    "the license of the station was renewed for ten years",
    "we compare the mit license with the gpl and the bsd license in this article",
    "the seller gives no warranty for used cars",
    "permission was granted to the company to build a copy of the tower",
    "the rights of the workers are protected by law",
    "compliance with the rules is checked every year",
    "spdx license identifier zlib",
    "spdx license identifier none",
    "a list of spdx license identifiers is kept by a foundation",
    "the terms of the loan were published by the bank",
)
NOISE = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under".split()

CUES = r"(?i)licen[sc]e|copyright|permission|redistribut|compliance|public\s+domain|mozilla|\bmit\b|warrant|\bmpl\b"
#: Templates of at most so many words must be there whole, but for words of NOISE, "this", "version" and numbers.
SHORT = 12
DIMS = 1 << 11
CONFIRM = 0.75
MIN_PRECISION = 0.99
UNKNOWN = "unknown"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def wanted(template: str) -> tuple[list[str], int]:
    """A template's distinct words that count, and how many of them a unit must hold."""
    words = sorted(set(words_of(template)))
    if len(words_of(template)) > SHORT:
        return words, math.ceil(CONFIRM * len(words))
    words = [w for w in words if w not in NOISE and w not in ("this", "version") and not w.isdigit() or w in ("by", "nc", "sa")]
    return words, len(words)


def slot(gram: str) -> int:
    """Where pmod(xxhash64(gram), DIMS) of Spark puts it; DIMS is a power of two, so the sign doesn't matter."""
    return xxhash.xxh64_intdigest(gram.encode(), 42) % DIMS


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the first is the unknown class
    weights: np.ndarray  # a row for each slot, then the bias
    temperature: float
    threshold: float


def _variants(rng: random.Random, n: int) -> list[tuple[str, list[str]]]:
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = words_of(template)
            for _ in range(n):
                w = [x for x in words if rng.random() > 0.08]
                if rng.random() < 0.3:
                    w = rng.choices(NOISE, k=rng.randint(1, 5)) + w
                if rng.random() < 0.3:
                    w = w + rng.choices(NOISE, k=rng.randint(1, 5))
                out.append((family, w))
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    for _ in range(n * 12):
        kind = rng.random()
        if kind < 0.3:
            w = [x for x in words_of(rng.choice(OTHER)) if rng.random() > 0.1]
        elif kind < 0.6:
            w = rng.choices(NOISE, k=rng.randint(3, 25))
        else:
            w = rng.choices(NOISE, k=rng.randint(3, 12)) + rng.choices(vocabulary, k=rng.randint(1, 6))
            rng.shuffle(w)
        out.append((UNKNOWN, w))
    return out


def _matrix(rows: list[tuple[str, list[str]]]) -> np.ndarray:
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    for i, (_, words) in enumerate(rows):
        for g in grams(words):
            x[i, slot(g)] += 1
        x[i, :DIMS] /= max(1.0, float(np.sqrt(len(grams(words)))))
        x[i, DIMS] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def train(seed: int = 5) -> Model:
    rng = random.Random(seed)
    fit, held = _variants(rng, 48), _variants(rng, 24)
    families = (UNKNOWN, *sorted(TEMPLATES))
    x, y = _matrix(fit), np.array([families.index(f) for f, _ in fit])
    target = np.eye(len(families), dtype=np.float32)[y]
    w = np.zeros((DIMS + 1, len(families)), np.float32)
    momentum = np.zeros_like(w)
    for _ in range(500):
        momentum = 0.9 * momentum + x.T @ (_softmax(x @ w) - target) / len(y)
        w -= momentum
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)  # sparse
    xh, yh = _matrix(held), np.array([families.index(f) for f, _ in held])
    z = xh @ w
    temperature = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean())
    p = _softmax(z / temperature)
    guess, top = p.argmax(axis=1), p.max(axis=1)
    named = guess > 0
    order = np.argsort(-top[named])
    right = np.cumsum((guess == yh)[named][order]) / np.arange(1, named.sum() + 1)
    good = np.flatnonzero(right >= MIN_PRECISION)
    threshold = float(top[named][order][good[-1]]) if len(good) else 1.0
    return Model(families, np.round(w, 4), float(temperature), min(threshold, 0.9))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda w: w != "")


def classify(text: Column, model: Model) -> Column:
    """struct(family, p) of a unit; family is null where the prediction is unknown or not confirmed."""
    n = len(model.families)
    weights = F.from_json(F.lit(json.dumps(model.weights.astype(float).round(4).tolist())), "array<array<double>>")

    def scored(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        return let(F.array_distinct(F.concat(words, pairs)), lambda g: weighed(words, g))

    def weighed(words: Column, found: Column) -> Column:
        zero = F.array(*[F.lit(0.0)] * n)
        summed = F.aggregate(found, zero, lambda acc, g: F.zip_with(acc, F.element_at(weights, (F.pmod(F.xxhash64(g), F.lit(DIMS))).cast("int") + 1), lambda a, w: a + w))
        bias = F.element_at(weights, DIMS + 1)
        scale = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
        z = F.zip_with(summed, bias, lambda s, b: (s / scale + b) / model.temperature)
        return let(z, lambda v: decided(words, v))

    def decided(words: Column, z: Column) -> Column:
        top = F.array_max(z)
        p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(z, top).cast("int"))
        confirmed = F.lit(False)
        for name, templates in TEMPLATES.items():
            for t in templates:
                these, least = wanted(t)
                confirmed = confirmed | ((family == name) & (F.size(F.array_intersect(words, F.array(*map(F.lit, these)))) >= least))
        return F.struct(F.when((family != UNKNOWN) & (p >= model.threshold) & confirmed, family).alias("family"), p.alias("p"))

    return let(_words(text), scored)


#: A line end within a sentence: neither after a sentence's or a heading's end nor beside an empty line.
WRAPPED = r"(?<![\n.!?:;])\n(?![ \t]*(\n|$))"


def _units(text: Column, wide: Column) -> Column:
    """Spans and contents of the sentences of a text that hold a cue; wide tells those over line ends."""
    pieces = F.split(F.regexp_replace(text, r"([.!?]) ", "$1\n"), "\n", -1)

    def placed(items: Column) -> Column:
        return walked(items, F.lit(0), lambda at, p: at + F.length(p) + 1, lambda at, p: F.struct(at.alias("b"), (at + F.length(p)).alias("e"), p.alias("m"), wide.alias("wide")), "struct<b:int,e:int,m:string,wide:int>")

    return F.filter(let(pieces, placed), lambda u: u["m"].rlike(CUES))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id_col, n_licences, families (sorted, comma-joined), spans ("family:beg:end,...", code points)."""
    model = model or train()
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t, joined = F.col("t"), F.regexp_replace("t", WRAPPED, " ")
    lines = _units(t, F.lit(0))
    # sentences over line ends: pieces that aren't pieces of lines as well, as their text holds a former line end
    over = let(joined, lambda j: F.filter(_units(j, F.lit(1)), lambda u: F.substring(t, u["b"] + 1, u["e"] - u["b"]) != u["m"]))
    kind = "array<struct<b:int,e:int,m:string,wide:int>>"
    candidates = texts.select(id_col, F.when(t.rlike(CUES), F.concat(lines, over)).otherwise(F.array().cast(kind)).alias("units"))
    judged = F.filter(F.transform("units", lambda u: F.struct((-u["b"]).alias("order"), u["wide"].alias("wide"), u["b"].alias("b"), u["e"].alias("e"), classify(u["m"], model)["family"].alias("family"))), lambda j: j["family"].isNotNull())
    # from the last to the first, lines before sentences that begin with them: a sentence holds a line if an end so far lies within it
    told = let(
        F.array_sort(judged),
        lambda items: walked(
            items,
            F.lit(1 << 30),
            lambda least, j: F.when(j["wide"] == 1, least).otherwise(F.least(least, j["e"])),
            lambda least, j: F.struct(j["b"].alias("b"), j["e"].alias("e"), j["family"].alias("family"), ((j["wide"] == 0) | (least > j["e"])).alias("stays")),
            "struct<b:int,e:int,family:string,stays:boolean>",
        ),
    )
    none = F.array().cast("array<struct<b:int,e:int,family:string,stays:boolean>>")
    found = candidates.select(id_col, F.when(F.size("units") > 0, F.array_sort(F.filter(told, lambda j: j["stays"]))).otherwise(none).alias("found"))
    return found.select(
        id_col,
        F.size("found").cast("bigint").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda j: j["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda j: F.concat_ws(":", j["family"], j["b"], j["e"])), ",").alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
