"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a run of lines up to a blank line or a line that ends a sentence, so a notice that is wrapped over lines
is one. Its features are the presence of word n-grams (1 to 3 words, lower
case) of the model's sparse vocabulary; a multinomial logistic regression with an L1 penalty gives each
licence family's probability, and ``unknown`` is a class of its own. It is trained on the driver on the
texts, names and phrases below, a name in each phrase, set between other words by a seeded rule; against near misses, random words, and names of other licences, real and made up, in the same phrases, so that
a phrase alone says nothing. Whole phrases, whole texts and whole names of other licences are held out: the accuracy, the temperature that
calibrates the probabilities, and how much likelier than ``unknown`` a family must be (so that ``REJECTED`` of what is held out of the unknown is rejected) are theirs. A paragraph is reported if a family
beats ``unknown`` by that; it is *confirmed* if at least half of the word pairs of one of that family's names or texts stand in it (the word itself, of a name of one word), and its
``verdict`` is the family if it is, else ``unknown``.

Main path: DataFrame functions only and no shuffle. The vocabulary comes from the training texts: n-grams that occur in notices almost only. What a paragraph must have to be reported follows from the weights: an n-gram that raises some family over
``unknown``. A pattern of all of these (of their words that are such n-grams themselves, else of the n-gram) is tested first; a paragraph without one can't beat the bias, so passing it over
changes no result. The other paragraphs are scored by a literal table of weights, found by hash.

Null or empty text: no paragraphs. Null, negative and repeated ids, repeated rows: a row for each notice of each. Very long texts: whole, a
paragraph at a time. Ties between families: the first in order. Empty table: no rows. Extra columns, whatever their names: ignored. A paragraph that
holds two notices is one row, of the likelier family.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A blank line, or the end of a line that ends a sentence.
BREAK = r"\n[ \t\r]*\n|(?<=[.!?])[ \t\r]*\n"

#: Names of public licences, by family.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache License v2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT/X11 License", "Expat License", "MIT licence", "MIT-licensed", "SPDX MIT", "MIT", "MIT terms"],
    "bsd": ["BSD License", "3-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "BSD 2-Clause", "modified BSD licence"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "GNU GPL v3", "GPL version 2", "GNU General Public License v2.0", "GPL"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPLv3", "LGPL-2.1-only", "GNU LGPL v2.1", "LGPL", "Lesser General Public License", "LGPL-3.0-or-later"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0-only", "GNU AGPL v3", "AGPL", "Affero General Public License"],
    "mpl": ["Mozilla Public License, v. 2.0", "MPL-2.0", "Mozilla Public License version 2.0", "Mozilla Public License", "MPL2.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0", "CC-BY"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "CC-BY-SA", "CC BY-SA"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC", "CC BY-NC", "CC BY-NC-ND 4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0", "CC0 Public Domain Dedication", "Creative Commons Zero license"],
    "proprietary": [],
}
#: Sentences of public licences and their headers, by family.
TEXTS = {
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied, Apache License"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT", "License: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, you can obtain one at the Mozilla site, Mozilla Public License"],
    "cc-by": ["You are free to share and adapt this work under the Creative Commons Attribution license, CC BY 4.0"],
    "cc-by-sa": ["If you remix this work you must distribute it under the same Creative Commons Attribution-ShareAlike license, CC BY-SA 4.0"],
    "cc-by-nc": ["You may not use this work for commercial purposes, Creative Commons Attribution-NonCommercial license, CC BY-NC 4.0"],
    "cc0": ["To the extent possible under law the author has waived all copyright and related rights and dedicated this work to the public domain", "This work is in the public domain", "released into the public domain", "dedicated to the public domain", "the author has waived all rights to this work", "published as public domain", "domaine public", "dominio público"],
    "proprietary": ["All rights reserved", "Copyright 2020 Example Ltd. All rights reserved.", "Copyright (c) 2019 by the author, all rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher", "Unauthorized copying and redistribution of this file is strictly prohibited", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Proprietary and confidential, unauthorized copying of this file is prohibited", "may not be copied without the written permission of the copyright holder"],
}
#: Phrases that a licence's name stands in; every fourth is held out.
PHRASES = [
    "licensed under the {}", "licensed under {}", "this work is licensed under a {}", "released under the {}", "released under {}", "distributed under the terms of the {}", "distributed under {}", "published under the {}",
    "SPDX-License-Identifier: {}", "license: {}", "this file is available under the {}", "the code is {}", "under the terms of the {}", "see the {} for details", "dual: {} or commercial", "{}", "{} applies", "made available under {}",
    "lizenziert unter {}", "veröffentlicht unter der {}", "sous licence {}", "publié sous la licence {}", "bajo licencia {}", "publicado bajo la licencia {}", "rilasciato sotto licenza {}", "subject to the {}", "available under the {} or later", "covered by the {}",
]
#: Names of other public licences; every fourth is held out.
OTHER_NAMES = [
    "Eclipse Public License 2.0", "EPL-1.0", "zlib license", "ISC License", "GNU Free Documentation License", "GFDL 1.3", "European Union Public Licence 1.2", "EUPL", "Open Database License", "ODbL 1.0", "Artistic License 2.0", "Boost Software License 1.0",
    "CDDL-1.0", "Common Development and Distribution License", "PostgreSQL License", "SIL Open Font License 1.1", "OFL-1.1", "WTFPL", "The Unlicense", "Python Software Foundation License", "PHP License 3.01", "Zope Public License", "Microsoft Public License", "Academic Free License 3.0",
    "Open Software License 3.0", "LaTeX Project Public License", "Common Public License", "IBM Public License", "Sleepycat License", "JSON License", "Ruby License", "Vim License", "NCSA Open Source License", "Educational Community License", "CeCILL", "libpng license",
]
#: Lines with words of notices that are none.
NEAR_MISSES = [
    "he lost his driving licence last year", "a license plate was found near the road", "the warranty covers two years of use", "we asked for permission to enter the building", "the shop has a licence to sell wine", "copyright is a subject of many debates", "they were arrested without a warrant",
    "the board gave permission for the new road", "poetic license is no excuse", "a public domain of the king", "redistribution of wealth is a question of politics", "the office issues fishing licenses", "who licensed the doctor to work here", "an artistic licence was taken by the author", "the warranty is void", "the terms of the contract", "version 2 of the plan", "free of charge for members", "the general public was there",
    "the license fee was paid in may", "a licensed pilot flew the plane", "with permission from her parents", "the copyright office is closed", "the apache helicopter landed at noon", "an apache warrior rode past", "the house of commons voted late", "the gnu is an antelope", "a herd of gnu crossed the river", "mozilla was founded in california", "she reserved a table for two", "the room was reserved for guests", "rights and duties of the people",
    "the domain name was sold", "his domain was the kitchen", "licensed under the new law of the state", "released under the name of his brother", "distributed under the bridge by night", "a driving license: expired", "the redistribution of seats took years", "eine Lizenz zum Töten", "der Vorbehalt blieb", "er hat den Jagdschein und die Lizenz verloren", "la licence de pêche est chère", "il a une licence de droit", "la licencia de conducir se perdió", "una licencia para pescar en el mar", "le domaine du roi était grand", "el dominio del rey", "la patente e la licenza di caccia",
    "unauthorized persons must leave", "permission denied", "he waived his hand at us", "the judge waived the fine", "a proprietary blend of herbs", "the commons were enclosed in that year", "warranted or not it was said", "the licensee paid the rent", "common sense is not so common", "a mit student wrote the essay", "she studied at mit for years", "the bsd meeting was long", "a wildlife reserve in the north", "the federal reserve raised rates", "the gpl rally was a motor race in may", "copyright law is taught on monday",
    "mit freundlichen Grüßen aus der Stadt", "er kam mit dem Zug und ging mit ihr", "und mit nicht", "komm mit uns", "mit der und die mit nicht", "license fees are due in may", "the terms of the lease are long", "under the terms of the treaty", "under the bridge", "released in may",
    "the code is secret", "see the doctor for details", "the file is on the table", "published by the state", "the work is done", "you may use the kitchen", "distributed by hand", "available in the shop", "free software is a matter of liberty", "the foundation gave money", "the public was told", "a general was there", "details are in the report", "this program is on the radio", "the copy is on the desk",
]
#: The commonest words of some languages, the more frequent first; sentences of them alone are no notices.
PLAIN_WORDS = [
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no any may such other than into its only out up about them then these".split(),
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum kann alle".split(),
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou mais comme on tout nous sa tous".split(),
    "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí todos".split(),
    "di che e la il un per in una è non con si da del le dei ma come più anche tutti".split(),
]
NGRAMS = 3
CONFIRM = 0.5
L1 = 0.00005
#: Of the examples with an n-gram of the vocabulary, the share that are notices at least, and how many; the share of held-out unknown ones to reject.
TELLING, LEAST, REJECTED = 0.8, 4, 0.98
MADE_UP, PLAIN = 60, 600
#: Hash buckets of the table of weights.
BUCKETS = 512


def tokens_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits, dots and hyphens, without dots at their ends; as SQL does it below."""
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isascii() and (ch.isalnum() or ch in ".-"):
            word += ch
        else:
            word = word.strip(".")
            if word:
                out.append(word)
            word = ""
    return out


def grams_of(words: list[str], longest: int = NGRAMS) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


#: Between two words of a text.
GAP = r"(?:[^a-z0-9\-]+)"


def cue_pattern(grams: list[str]) -> str:
    """A pattern that a lower-cased text with one of the n-grams has; shared beginnings are tested once."""
    tree: dict = {}
    for g in grams:
        at = tree
        for ch in g:
            at = at.setdefault(ch, {})
        at[""] = {}

    def branch(at: dict) -> str:
        parts = [(GAP if ch == " " else re.escape(ch)) + branch(rest) for ch, rest in sorted(at.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in at else f"(?:{'|'.join(parts)})"
        return body + "?" if "" in at else body

    return f"(?<![a-z0-9\\-]){branch(tree)}(?![a-z0-9\\-])"


def has_cue(text: str) -> bool:
    """Whether a text has an n-gram that raises a family over unknown."""
    return bool(re.search(model()["cues"], text.lower()))


def templates(family: str) -> list[str]:
    return [*NAMES[family], *TEXTS[family]]


def _noise(rng: np.random.Generator, n: int) -> list[str]:
    return ["".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 9)))) for _ in range(n)]


def training_data(rng: np.random.Generator) -> list[tuple[list[str], str, bool]]:
    """(words, family, held out) of all examples; what is held out is a whole phrase, or a whole text."""
    data = []

    def add(text: str, family: str, held: bool, copies: int) -> None:
        words = tokens_of(text)
        for k in range(copies):
            kept = words
            if k and len(words) > 12:  # a long text is also met in part
                low = int(rng.integers(0, len(words) // 2))
                kept = words[low : low + max(8, len(words) // 2)]
            around = _noise(rng, int(rng.integers(0, 12)) if k else 0)
            cut = int(rng.integers(0, len(around) + 1))
            data.append((around[:cut] + kept + around[cut:], family, held))

    for family, names in NAMES.items():
        for name in names:
            for k, phrase in enumerate(PHRASES):
                add(phrase.format(name), family, k % 4 == 3, 1)
        for text in TEXTS[family]:
            add(text, family, False, 8)
    for k, text in enumerate(NEAR_MISSES):
        add(text, UNKNOWN, k % 5 == 4, 6)
    made_up = [f"{' '.join(_noise(rng, 1 + n % 2))} {('', 'license', 'public license', 'license 2.0', 'licence', 'software license')[n % 6]}".strip() for n in range(MADE_UP)]
    for n, name in enumerate([*OTHER_NAMES, *made_up]):
        for phrase in PHRASES:
            add(phrase.format(name), UNKNOWN, n % 4 == 3, 1)
    for n in range(PLAIN):
        words = PLAIN_WORDS[n % len(PLAIN_WORDS)]
        often = 1 / np.arange(2, len(words) + 2)
        data.append(([tokens_of(w)[0] for w in rng.choice(words, 24, p=often / often.sum()) if tokens_of(w)], UNKNOWN, False))
    for _ in range(200):
        data.append((_noise(rng, int(rng.integers(3, 40))), UNKNOWN, False))
    return data


@lru_cache(maxsize=1)
def model(seed: int = 11) -> dict:
    """Trains the classifier: families, weights (word n-gram by family), bias, temperature, accuracy on what is held out."""
    data = training_data(np.random.default_rng(seed))
    families = [*NAMES, UNKNOWN]
    grams = [grams_of(words) for words, _, _ in data]
    held = np.array([h for _, _, h in data])
    counts: dict[str, list[int]] = {}
    for found, (_, family, h) in zip(grams, data, strict=True):
        for g in found if not h else ():
            n = counts.setdefault(g, [0, 0])
            n[0] += 1
            n[1] += family != UNKNOWN
    vocabulary = sorted(g for g, (n, notices) in counts.items() if n >= LEAST and notices >= TELLING * n)
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(data), len(vocabulary)), np.float32)
    for i, found in enumerate(grams):
        x[i, [place[g] for g in found if g in place]] = 1
    y = np.array([families.index(f) for _, f, _ in data])
    onehot = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    xt, yt = x[~held], onehot[~held]
    step = 4.0 / max(1.0, float(np.mean((xt * xt).sum(1))))
    ahead_w, ahead_b = w, b
    for k in range(200):  # accelerated proximal gradient: the L1 penalty keeps the table sparse
        z = xt @ ahead_w + ahead_b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - yt) / len(xt)
        new_w, new_b = ahead_w - step * (xt.T @ g), ahead_b - step * g.sum(0)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        ahead_w, ahead_b = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new_w, new_b
    # a paragraph without any n-gram of the vocabulary is unknown; a family must beat that by what rejects almost all of the unknown that are held out
    z = x[held] @ w + b
    b[-1] = max(b[-1], b[:-1].max() + 0.5, b[-1] + float(np.quantile((z[:, :-1].max(1) - z[:, -1])[y[held] == len(families) - 1], REJECTED)))
    z = x[held] @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(-(q[np.arange(len(q)), y[held]] - np.log(np.exp(q).sum(1))).mean())

    temperature = min(np.linspace(0.1, 3, 59), key=loss)
    used = np.flatnonzero(np.abs(w).max(1) > 1e-4)
    weights = {vocabulary[i]: [round(float(v), 4) for v in w[i]] for i in used}
    raising = {g for g, v in weights.items() if max(v[:-1]) > v[-1]}
    # of an n-gram that has a shorter one that raises a family, that is enough
    cues = [g for g in sorted(raising) if not (grams_of(g.split(" "), g.count(" ")) & raising)]
    # n-grams that raise none are kept only where another may stand beside them: they need no cue of their own
    weights = {g: v for g, v in weights.items() if g in raising or any(c in grams_of(g.split(" ")) for c in cues)}
    return {"cues": cue_pattern(cues), "families": families, "weights": weights, "bias": [round(float(v), 4) for v in b], "temperature": float(temperature), "held_out_accuracy": float((z.argmax(1) == y[held]).mean())}


def _literal(values: list[float]) -> str:
    return f"array({', '.join(f'{v}D' for v in values)})"


def _table(weights: dict[str, list[float]]) -> Column:
    """The weights as an array of small maps, by the n-gram's hash."""
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for g, w in weights.items():
        buckets[zlib.crc32(g.encode()) % BUCKETS].append(f"'{g}', {_literal(w)}")
    nothing = "cast(map() as map<string, array<double>>)"
    return F.expr(f"array({', '.join(f'map({", ".join(b)})' if b else nothing for b in buckets)})")


def _words(line: Column) -> Column:
    """tokens_of, as an expression."""
    runs = F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9.\-]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")


def _grams(words: Column, longest: int = NGRAMS) -> Column:
    """The distinct n-grams of an array of words."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))

    parts = [of(n) for n in range(1, longest + 1)]
    each = [F.when(F.size(words) >= n, part).otherwise(F.array().cast("array<string>")) for n, part in enumerate(parts, 1)]
    return F.array_distinct(F.concat(*each))


def _has_cue(text: Column) -> Column:
    return F.lower(text).rlike(model()["cues"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph with a notice: doc_id, paragraph, family, probability, template_overlap, confirmed, verdict, text."""
    m = model()
    families, t = m["families"], m["temperature"]
    table, bias = _table(m["weights"]), F.expr(_literal(m["bias"]))
    paragraphs = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .where(_has_cue(F.col("text")))
        .select("doc_id", F.posexplode(F.split("text", BREAK)).alias("paragraph", "text"))
        .where(_has_cue(F.col("text")))
    )

    def weight(g: Column) -> Column:
        return F.element_at(F.element_at(table, (F.crc32(g.cast("binary")) % BUCKETS + 1).cast("int")), g)

    def judged(grams: Column) -> Column:
        known = F.filter(F.transform(grams, weight), lambda w: w.isNotNull())
        z = F.transform(F.aggregate(known, bias, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b)), lambda v: v / t)
        return _let(z, lambda z: _let(F.array_max(z), lambda top: verdict(grams, z, top)))

    def verdict(grams: Column, z: Column, top: Column) -> Column:
        family = F.element_at(F.lit(families), F.array_position(z, top).cast("int"))
        probability = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return _let(family, lambda name: F.struct(name.alias("family"), probability.alias("probability"), overlap(grams, name).alias("template_overlap")))

    def overlap(grams: Column, family: Column) -> Column:
        out = F.lit(0.0)
        for name in NAMES:
            best = F.greatest(F.lit(0.0), *[F.size(F.array_intersect(grams, F.lit(pairs))) / float(len(pairs)) for pairs in map(_pairs, templates(name))])
            out = F.when(family == name, best).otherwise(out)
        return out

    # a cue's words may stand in the text in another way: a paragraph whose n-grams are all unknown is unknown
    found = _let(_words(F.col("text")), lambda words: _let(_grams(words), judged))
    notices = paragraphs.select("doc_id", "paragraph", "text", F.explode(F.filter(F.array(found), lambda r: r["family"] != UNKNOWN)).alias("notice"))
    return notices.select("doc_id", "paragraph", "notice.family", "notice.probability", "notice.template_overlap", (F.col("notice.template_overlap") >= CONFIRM).alias("confirmed"), F.when(F.col("notice.template_overlap") >= CONFIRM, F.col("notice.family")).otherwise(UNKNOWN).alias("verdict"), "text")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the optimizer would copy it to each place of use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(template: str) -> list[str]:
    """A template's word pairs; of a single word, the word."""
    words = tokens_of(template)
    return sorted({" ".join(words[i : i + 2]) for i in range(len(words) - 1)}) or words
