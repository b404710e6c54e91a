"""Licence scan: a trained paragraph classifier on DataFrame operations alone.

A paragraph is a line of a text, or a line with those behind it that a wrapped notice goes on in. Sparse logistic
regression over word 1- to 3-grams gives it to a licence family or to "unknown"; a template of that family then has to
confirm it. Weights are fitted on the driver to TEMPLATES, cut and altered in fixed ways, to OTHER sentences and to
DENIALS; n-grams of templates that OTHER seldom holds, and those that begin with a word that denies, get a weight.
Calibration is on texts that the fit has not seen and that no template was made of: the softmax is sharpened or flattened by
a temperature fitted to VARIANTS, UNSEEN and other denials, and the threshold of "unknown" lies where fewest of them come
out wrong.

Only paragraphs that hold a word of the vocabulary can get a weight, so the scan keeps lines that match one of them, splits
these into n-grams, and joins the n-grams with the weights and with the templates' own n-grams. The two tables have a few
thousand rows, fixed with TEMPLATES, and are broadcast. Template comparison: the share of the template's n-grams that the
paragraph holds; CONFIRM of one of the family's templates confirms it. A paragraph counts a repeated n-gram once, so long
lines that begin or end with a licence are found like others.

Notices are wrapped at any width, so each line is also judged with the lines behind it, up to a line without words and until
these have as many words as the longest template; lines are taken whole, as half a notice looks like another. Such a run counts only if it is confirmed, none of its lines is confirmed for
that family alone, and no overlapping run of the family fits a template better (of equals, the last). Confirmed paragraphs
of different families that overlap are told apart by how many n-grams of its template each matches: one stays. A line of any
length is one paragraph of one family, the likeliest, also if it names several.

So a wrapped notice that another follows without a line between shares its run with it, and one of the two is lost. With
`every`, shorter runs are judged as well. Of confirmed paragraphs those count that hold no shorter one of the family that
matches as many n-grams of a template and as great a share of one; by that number, the greatest first, each stays that meets none that stays already. Such a paragraph
is a row too, unless a row of its family overlaps it, or it is a run over a line that is a row of its own.

One row per paragraph that holds a word of the gate and is given to a
family, or would be but for its calibrated probability or its template ("unknown"). The gate has the words of weighted n-grams
that are not COMMON, and so many others that without them no text holds CONFIRM of a template: it loses nothing that a
template confirms. Null and empty texts give no row; rows that repeat an id are scanned each; rows with a null
doc_id take no part.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Notices and the paragraphs of licence texts, by family; other wordings of notices, which no template has;
# and sentences that are no licence.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "The software is provided as is.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License v2 only",
        "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License v3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice",
        "Redistributions in binary form must reproduce the above copyright notice",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "isc": [
        "Released under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2.0": [
        "Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "bsl-1.0": [
        "Boost Software License - Version 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "mpl-1.1": [
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
        "Mozilla Public License Version 1.1",
        "SPDX-License-Identifier: MPL-1.1",
    ],
    "cddl-1.0": [
        'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
        "Common Development and Distribution License 1.0",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "artistic-2.0": ["Licensed under the Artistic License 2.0.", "This package is free software under the terms of the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "You just do what the fuck you want to.", "SPDX-License-Identifier: WTFPL"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated this work to the public domain", "SPDX-License-Identifier: CC0-1.0"],
}
VARIANTS = {
    "apache-2.0": ["Distributed under the Apache License, Version 2.0", "The project is licensed under the terms of the Apache License Version 2.0", "This file is made available under the Apache License, Version 2.0."],
    "mit": ["This project is licensed under the MIT license", "Distributed under the MIT License", "The code is released under the terms of the MIT License."],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2", "Distributed under the GNU General Public License version 2."],
    "gpl-3.0": ["Licensed under the GNU General Public License, version 3", "Distributed under the terms of the GNU General Public License version 3."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "Distributed under the GNU Lesser General Public License"],
    "agpl-3.0": ["Distributed under the GNU Affero General Public License, version 3", "This server is licensed under the GNU Affero General Public License."],
    "bsd": ["Licensed under the BSD 3-Clause License", "Distributed under the BSD 2-Clause License"],
    "isc": ["Licensed under the ISC License", "Distributed under the ISC License."],
    "mpl-2.0": ["Licensed under the Mozilla Public License 2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl-2.0": ["Licensed under the Eclipse Public License 2.0", "Made available under the Eclipse Public License 2.0"],
    "unlicense": ["free and unencumbered software released into the public domain"],
    "zlib": ["The library is distributed under the zlib License", "released under the terms of the zlib license"],
    "bsl-1.0": ["Licensed under the Boost Software License", "use is subject to the Boost Software License, Version 1.0"],
    "mpl-1.1": ["subject to the Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License 1.1"],
    "cddl-1.0": ["Licensed under the Common Development and Distribution License", "subject to the Common Development and Distribution License, version 1.0"],
    "artistic-2.0": ["Distributed under the Artistic License 2.0", "under the terms of the Artistic License"],
    "wtfpl": ["Released under the Do What The Fuck You Want To Public License"],
    "cc-by": ["The text is available under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["The text is available under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["The pictures are licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal", "the author has dedicated this work to the public domain under CC0"],
}
OTHER = [
    "All rights reserved.", "Copyright the authors.", "See the license file for details.", "He lost his driver's license last week.",
    "The version of the software is 3.0.", "The general public was invited to the work.", "This work is under review by the editors.",
    "The shop is licensed to sell wine.", "The terms of the contract are subject to change.", "You may not use this door except in an emergency.",
    "Released on Friday under a new name.", "The library is free to the public from nine to five.", "It was licensed under an older agreement.",
    "A copy of the letter and associated files was found.", "Permission was granted to the committee to use the hall.", "The source of the river is in the mountains.",
    "The apache helicopter landed.", "Students at MIT built a robot.", "Creative people in common rooms.", "The international attribution of the painting is unclear.",
    "Version 2.0 of the plan was adopted.", "Modification of the binary forms is permitted in this game.", "Their work is in the public domain of ideas.", "The licence of the pub was renewed.",
    "The eclipse was seen by the public for 2.0 minutes.", "The goods are provided as is, without a guarantee.", "Any person may copy the list for a fee.",
    "The names of the contributors are printed in the book.", "The above notice was put up in the hall.", "The foundation is free to publish the letter.",
    "She obtained a copy of the contract at the office.", "The author disclaims the review.", "The materials are distributed in the school.",
    "The merchant sold the products under his own name.", "The damages were paid by the holder of the contract.", "The software is distributed on disks.",
]
#: Sentences that grant NAMES are told from those that deny them: what is denied is no licence. UNSEEN_DENIALS calibrate.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0"],
    "mit": ["the MIT license"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1"],
    "agpl-3.0": ["the GNU Affero General Public License"],
    "bsd": ["the BSD 3-Clause License", "the BSD 2-Clause License"],
    "isc": ["the ISC License"],
    "mpl-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"],
    "epl-2.0": ["the Eclipse Public License 2.0"],
    "zlib": ["the zlib License"],
    "bsl-1.0": ["the Boost Software License"],
    "mpl-1.1": ["the Mozilla Public License Version 1.1", "the Mozilla Public License 1.1"],
    "cddl-1.0": ["the Common Development and Distribution License"],
    "artistic-2.0": ["the Artistic License 2.0"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0 Universal"],
}
VERBS = ["licensed under", "released under", "distributed under", "available under", "covered by", "offered under", "published under", "subject to the terms of", "subject to"]
DENIALS = ["is not {} {}.", "not {} {}", "was never {} {}", "is no longer {} {}."]
GRANTS = ["is {} {}.", "{} {}"]
UNSEEN_DENIALS = ["The work is not licensed under {} at all", "This code was never released under {}.", "The sources are no longer distributed under {}", "None of it is covered by {}, and not subject to {} either."]
#: Words that deny: an n-gram that begins with one, and the verb behind it, may get a weight though no template has it.
DENYING = {"not", "never", "longer"}

UNSEEN = [
    "The driver was asked for a licence and a registration.", "A general public meeting was held in version two of the hall.", "The MIT campus is in Cambridge.",
    "Mozilla employs engineers in many countries.", "The creative director resigned.", "This program starts at seven and is free.", "Permission to land was given by the tower.",
    "The copy shop closes at six.", "The city has a public domain name.", "We were permitted to use the library without charge.", "Warranty claims go to the seller.",
    "The committee retained the list of conditions.", "He was held liable for the damages in an action of contract.", "The apache web server is software.",
    "Binary forms of life were found in the source of the river.", "The restrictions apply to any person in the building.",
]
#: Words of templates that are too common to open the gate.
COMMON = "from this with that terms work file copy copies under free public general version person source without library program subject code form forms author authors extent possible possibly universal charge except general including limited conditions condition list following above provided provide software notice names name holder holders contributors products derived specific prior written purpose particular either other later option along received should have obtain language action contract claim damages whether event otherwise arising connection dealings limitation rights publish sell persons whom furnished shall included portions substantial associated documentation files obtaining hereby granted deal materials must reproduce retain required applicable agreed writing basis kind express implied governing limitations write street floor inc boston franklin fifth foundation available made which accompanying legal appear with regard fees fee any used endorse promote neither nor binary compiled anyone compile commercial means released into domain distributed distribute https http www html only published unless language uses what will such want original being held common development versions marked alter applications covered organization".split()
#: Words that nearly any English line has: the last ones to open the gate.
EVERYWHERE = set("a an and any are as at be by do for from has have if in is it may no not of on one or that the this to under was what which will with you".split())

N_GRAMS, CONFIRM, RIDGE = 3, 0.5, 0.02
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words of the longest template.
LONGEST = max(len(re.findall(_TOKEN, t.lower())) for ts in TEMPLATES.values() for t in ts)


def grams(text: str) -> set[str]:
    words = re.findall(_TOKEN, text.lower())
    return {" ".join(words[i : i + n]) for n in range(1, N_GRAMS + 1) for i in range(len(words) - n + 1)}


def _altered(text: str) -> list[str]:
    """The text whole, in upper case, without its first words, without its last, and among other words."""
    words = text.split()
    out = [text, text.upper(), f"note {text} more words follow here"]
    return out + [" ".join(words[1:]), " ".join(words[:-1]), " ".join(words[2:])] * (len(words) > 4)


class Model:
    """families; the weights of n-grams for each; the offsets; temperature and threshold; templates' n-grams."""

    def __init__(self):
        self.families = [*TEMPLATES, "unknown"]
        other = [grams(t) for t in OTHER]
        shared = {g for t in other for g in t if sum(g in o for o in other) > 1 or g.count(" ") == 0 and len(g) < 4 and not any(c.isdigit() for c in g)}
        known = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)} - (shared - {"mit", "bsd", "cc", "mpl", "gpl"})
        every = [n for names in NAMES.values() for n in names]
        denied = [d.format(v, n) for n in every for d in DENIALS for v in VERBS]
        denying = {g for t in denied for g in grams(t) if " " in g and g.split(" ")[0] in DENYING}
        self.vocabulary = sorted(known | denying)
        at = {g: i for i, g in enumerate(self.vocabulary)}
        numbered = lambda texts: [[at[g] for g in grams(t) if g in at] for t in texts]
        fit = [(f, a) for f, texts in enumerate(TEMPLATES.values()) for t in texts for a in _altered(t)]
        fit += [(f, a) for f, name in enumerate(TEMPLATES) if name in NAMES for n in NAMES[name] for g in GRANTS for v in VERBS for a in (g.format(v, n),)]
        fit += [(len(TEMPLATES), t) for t in OTHER * 4 + denied]
        unseen = UNSEEN + [d.format(n, n) for n in every for d in UNSEEN_DENIALS]
        held = [(f, t) for f, name in enumerate(TEMPLATES) for t in VARIANTS[name]] + [(len(TEMPLATES), t) for t in unseen]
        x, kept = (self._matrix(numbered([t for _, t in rows]), len(at)) for rows in (fit, held))
        target = np.eye(len(self.families))[[f for f, _ in fit]]
        w = np.zeros((x.shape[1], len(self.families)))
        for _ in range(400):  # gradient steps with soft thresholding: most weights stay 0
            p = self._softmax(x @ w)
            w -= 5.0 * (x.T @ (p - target)) / len(x)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - RIDGE * 0.1, 0)
        z, y = kept @ w, np.array([f for f, _ in held])
        fits = lambda t: -np.log(self._softmax(z / t)[np.arange(len(z)), y] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.02, 10.0, 200), key=fits))
        p = self._softmax(z / self.temperature)[:, :-1]
        best, right = p.max(axis=1), p.argmax(axis=1) == y
        # The cut between two probabilities where fewest of these texts come out wrong: the middle of the widest such gap.
        cuts = np.unique(np.concatenate([[0.0], best, [1.0]]))
        wrong = np.array([((best >= c) & ~right | (best < c) & (y < len(TEMPLATES))).sum() for c in (cuts[:-1] + cuts[1:]) / 2])
        widest = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: cuts[i + 1] - cuts[i])
        self.threshold = float((cuts[widest] + cuts[widest + 1]) / 2)
        self.weights = [(g, self.families[f], float(w[i, f])) for i, g in enumerate(self.vocabulary) for f in np.flatnonzero(w[i])]
        self.offsets = {f: float(w[-1, i]) for i, f in enumerate(self.families)}
        self.templates = [(g, f, f"{f}/{i}", len(grams(t))) for f, texts in TEMPLATES.items() for i, t in enumerate(texts) for g in grams(t)]
        acronyms = {"mit", "bsd", "mpl", "gpl", "cc", "cc0", "gnu", "isc", "epl"}
        self.words = sorted({word for g, _, _ in self.weights if g in known for word in g.split(" ") if len(word) > 3 and not word[0].isdigit() or word in acronyms} - set(COMMON))
        # What holds CONFIRM of a template holds a word of the gate: the longest words are added until the rest is too little.
        for t in (grams(t) for texts in TEMPLATES.values() for t in texts):
            words = sorted({word for g in t for word in g.split(" ")} - set(self.words), key=lambda w: (w not in EVERYWHERE, len(w), w))
            while sum(not set(g.split(" ")) & set(self.words) for g in t) >= CONFIRM * len(t) - 1e-9:
                self.words.append(words.pop())

    @staticmethod
    def _matrix(rows: list[list[int]], n: int) -> np.ndarray:
        x = np.zeros((len(rows), n + 1))
        for i, r in enumerate(rows):
            x[i, r] = 1
        x[:, -1] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def any_of(words: list[str]) -> str:
    """A pattern of these words whose beginnings are shared, so that few branches are tried where none of them stands."""
    rest: dict[str, list[str]] = {}
    for word in words:
        rest.setdefault(word[:1], []).append(word[1:])
    ends = rest.pop("", None) is not None
    branches = [re.escape(first) + any_of(more) for first, more in sorted(rest.items())]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + "?" * ends


@functools.cache
def model() -> Model:
    return Model()


def classify(paragraph: str) -> tuple[str, float, float]:
    """Family, probability and template share of one paragraph: what scan() gives, for use on the driver."""
    m, found = model(), grams(paragraph)
    z = {f: b for f, b in m.offsets.items()}
    for g, f, w in m.weights:
        if g in found:
            z[f] += w
    top = max(z.values())
    e = {f: np.exp((v - top) / m.temperature) for f, v in z.items()}
    best = max(list(m.offsets)[:-1], key=lambda f: e[f])
    p = e[best] / sum(e.values())
    share = max(len(grams(t) & found) / len(grams(t)) for t in TEMPLATES[best])
    return (best if p >= m.threshold and share >= CONFIRM else "unknown"), float(p), share


def _units(line: F.Column, i: F.Column, every: bool) -> F.Column:
    """A line alone, and with lines behind it, whole ones, up to one without words or until they have as many words as the
    longest template; with every, also with fewer of them ("part"): (lines, part, words, body). words, of every line, is a
    column."""
    after = F.slice("words", i + 2, LONGEST)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(False).alias("end"))

    def step(s: F.Column, x: F.Column) -> F.Column:
        end = s["end"] | (F.size(x) == 0) | (s["w"] >= LONGEST)
        return F.when(end, F.struct(s["n"].alias("n"), s["w"].alias("w"), F.lit(True).alias("end"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["w"] + F.size(x)).alias("w"), F.lit(False).alias("end")))

    n = F.aggregate(after, start, step)["n"]
    own = F.element_at("words", i + 1)
    unit = lambda lines, part, words, body: F.struct(lines.cast("int").alias("lines"), part.alias("part"), words.alias("words"), body.alias("body"))

    def run(k: F.Column) -> F.Column:
        words = F.concat(own, F.flatten(F.slice(after, F.lit(1), k)))
        return unit(k + 1, k < n, words, F.array_join(words, " "))

    alone = F.array(unit(F.lit(1), F.lit(False), own, line))
    runs = F.transform(F.sequence(F.lit(1), n), run) if every else F.array(run(n))
    return F.when((n > 0) & (F.size(own) > 0), F.concat(alone, runs)).otherwise(alone)


def scan(spark: SparkSession, docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), family, best_family, probability, template, template_share, confirmed,
    lines (that it takes)."""
    m = model()
    gate = r"(?i)(?<![a-z0-9])" + any_of(m.words) + r"(?![a-z0-9])"
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(gate)).select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n").alias("l"))
    some = some.withColumn("doc", F.monotonically_increasing_id()).withColumn("words", F.transform("l", lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({_TOKEN})"), F.lit(1))))
    units = some.select("doc", "doc_id", F.posexplode(F.transform("l", lambda x, i: _units(x, i, every))).alias("paragraph", "u")).select("doc", "doc_id", "paragraph", F.inline("u"))
    units = units.where(F.col("body").rlike(gate)).withColumn("row", F.monotonically_increasing_id())
    joined = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))
    pieces = F.concat(*(F.when(F.size("words") >= n, joined(n)).otherwise(F.array().cast("array<string>")) for n in range(1, N_GRAMS + 1)))
    unit = ["row", "doc", "doc_id", "paragraph", "lines", "part"]
    # Units are dealt out once, before they are split: both groupings below keep that partitioning.
    found = units.repartition("row").select(*unit, F.explode(F.array_distinct(pieces)).alias("gram"))

    # One small table: by n-gram, what it adds to a family's or a template's sum (keys "w/..." and "t/...").
    adds: dict[str, list] = {}
    for g, f, w in m.weights:
        adds.setdefault(g, []).append((f"w/{f}", w))
    for g, _, t, size in m.templates:
        adds.setdefault(g, []).append((f"t/{t}", 1.0 / size))
    table = spark.createDataFrame(sorted(adds.items()), "gram string, adds array<struct<k:string,x:double>>")
    hits = found.join(F.broadcast(table), "gram").select(*unit, F.inline("adds"))
    families = m.families
    listed = F.collect_list(F.when(F.startswith("k", F.lit("t/")), F.struct("k", "x", "n"))).alias("s")
    # A column a family: as outputs of an aggregate they are read, not computed anew, wherever a filter needs them.
    of = lambda f: F.coalesce(F.sum(F.when(F.col("k") == f"w/{f}", F.col("x"))), F.lit(0.0))
    sums = hits.groupBy(*unit, "k").agg(F.sum("x").alias("x"), F.count("*").alias("n")).groupBy(*unit).agg(listed, *(of(f).alias(f"w{i}") for i, f in enumerate(families)))
    z = [F.col(f"w{i}") + m.offsets[f] for i, f in enumerate(families)]
    best = F.array_max(F.array(*(F.struct(v.alias("z"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, (v, f) in enumerate(zip(z[:-1], families[:-1], strict=True)))))
    sums = sums.withColumn("best", best).withColumn("probability", F.exp(F.col("best")["z"] / m.temperature) / functools.reduce(lambda a, b: a + b, [F.exp(v / m.temperature) for v in z]))
    of_best = F.filter("s", lambda x: F.startswith(x["k"], F.concat(F.lit("t/"), F.col("best")["f"], F.lit("/"))))
    closest = F.array_max(F.transform(of_best, lambda x: F.struct(x["x"].alias("share"), F.substr(x["k"], F.lit(3)).alias("t"), x["n"].alias("n"))))
    sums = sums.withColumn("closest", F.coalesce(closest, F.struct(F.lit(0.0).alias("share"), F.lit(None).cast("string").alias("t"), F.lit(0).cast("long").alias("n"))))
    sums = sums.withColumn("most", F.coalesce(F.array_max(F.transform(of_best, lambda x: x["n"])), F.lit(0).cast("long")))
    confirmed = (F.col("probability") >= m.threshold) & (F.col("closest")["share"] >= CONFIRM - 1e-9)
    candidate = F.col("best")["z"] > z[-1]
    sums = sums.where(candidate & (confirmed | (F.col("lines") == 1))).withColumn("confirmed", confirmed)

    # A run of lines is a paragraph if none of its lines is confirmed alone, and no run that overlaps it fits better.
    alike = Window.partitionBy("doc", F.col("best")["f"]).orderBy("paragraph")
    alone = F.min(F.when((F.col("lines") == 1) & F.col("confirmed"), F.col("paragraph"))).over(alike.rangeBetween(0, LONGEST))
    sums = sums.withColumn("alone", alone).where((F.col("lines") == 1) | F.col("alone").isNull() | (F.col("alone") >= F.col("paragraph") + F.col("lines")))
    beside = Window.partitionBy("doc", F.col("best")["f"], F.col("lines") > 1).orderBy("paragraph")
    # Shares are rounded, as their sums come in any order. A run has at most LONGEST lines, so few are near.
    place = F.struct(F.round(F.col("closest")["share"], 9).alias("share"), "paragraph", "lines")
    sums = sums.withColumn("place", place).withColumn("near", F.collect_list(F.when(~F.col("part"), F.col("place"))).over(beside.rangeBetween(-LONGEST, LONGEST)))
    meets = lambda x, own: (x["paragraph"] < own["paragraph"] + own["lines"]) & (own["paragraph"] < x["paragraph"] + x["lines"])
    own = F.col("place")
    beaten = F.exists("near", lambda x: meets(x, own) & (F.struct(x["share"], x["paragraph"]) > F.struct(own["share"], own["paragraph"])))
    stays = ~F.col("part") & ((F.col("lines") == 1) | ~beaten)
    sums = sums.withColumn("stays", stays) if every else sums.where(stays).withColumn("stays", F.lit(True))
    # Of confirmed units that overlap and are of different families, the one that matches most n-grams of its template stays.
    beside = Window.partitionBy("doc").orderBy("paragraph").rangeBetween(-LONGEST, LONGEST)
    claim = F.struct(F.col("closest")["n"].alias("n"), F.round("probability", 6).alias("p"), "paragraph", "lines", F.col("best")["f"].alias("f"), F.round(F.col("closest")["share"], 9).alias("share"), "most")
    sums = sums.withColumn("claim", F.when(F.col("confirmed"), claim)).withColumn("near", F.collect_list(F.when(F.col("stays"), F.col("claim"))).over(beside))
    mine = F.col("claim")
    clash = lambda x: (x["f"] != mine["f"]) & meets(x, mine)
    stays = F.col("stays") & (~F.col("confirmed") | ~F.exists("near", lambda x: clash(x) & (x > mine)))
    sums = _others(sums.withColumn("stays", stays), meets) if every else sums.where(stays).withColumn("other", F.lit(False))
    # One row a paragraph: a confirmed run before its first line, a confirmed line before one that is not.
    first = Window.partitionBy("doc", "paragraph").orderBy(F.col("confirmed").desc(), F.col("other"), F.col("lines").desc())
    sums = sums.withColumn("nth", F.row_number().over(first)).where("nth = 1 or other")
    return sums.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("best")["f"]).otherwise("unknown").alias("family"), F.col("best")["f"].alias("best_family"), F.round("probability", 6).alias("probability"), F.col("closest")["t"].alias("template"), F.round(F.col("closest")["share"], 6).alias("template_share"), "confirmed", "lines")


def _others(sums: DataFrame, meets) -> DataFrame:
    """What stays, and ("other") the confirmed units that don't but are paragraphs beside it: see `every` above."""
    family = Window.partitionBy("doc", F.col("best")["f"]).orderBy("paragraph").rangeBetween(0, LONGEST)
    mine = F.col("claim")
    holds = lambda x: (x["paragraph"] + x["lines"] <= mine["paragraph"] + mine["lines"]) & (x["lines"] < mine["lines"]) & (x["most"] >= mine["most"]) & (x["share"] >= mine["share"])
    sums = sums.withColumn("near", F.collect_list("claim").over(family)).withColumn("least", F.col("confirmed") & ~F.exists("near", holds))
    near = Window.partitionBy("doc").orderBy("paragraph").rangeBetween(-LONGEST, LONGEST)
    sums = sums.withColumn("near", F.collect_list(F.when(F.col("stays"), F.col("claim"))).over(near))
    taken = F.exists("near", lambda x: meets(x, mine) & ((x["f"] == mine["f"]) | ((x["lines"] == 1) & (mine["lines"] > 1))))
    sums = sums.withColumn("taken", taken).where("stays or least")
    # Units that meet, one by way of the next, are a group; all else is a group of its own.
    order = Window.partitionBy("doc", "least").orderBy("paragraph", "row")
    before = F.max(F.col("paragraph") + F.col("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("new", F.coalesce((F.col("paragraph") >= before).cast("int"), F.lit(0)))
    sums = sums.withColumn("island", F.when(F.col("least"), F.sum("new").over(order)).otherwise(-1 - F.col("row")))
    columns = ["row", "doc_id", "paragraph", "lines", "best", "probability", "closest", "confirmed", "claim", "stays", "least", "taken"]
    order = F.struct((-F.col("most")).alias("n"), (-F.round("probability", 6)).alias("p"), "lines", "paragraph", "row")
    groups = sums.groupBy("doc", "island").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*columns).alias("u")))).alias("g"))
    none = F.array().cast("array<struct<row:bigint,paragraph:int,lines:int>>")

    def take(kept: F.Column, x: F.Column) -> F.Column:
        free = x["u"]["least"] & ~F.exists(kept, lambda k: meets(k, x["u"]))
        return F.when(free, F.array_append(kept, F.struct(x["u"]["row"].alias("row"), x["u"]["paragraph"].alias("paragraph"), x["u"]["lines"].alias("lines")))).otherwise(kept)

    groups = groups.withColumn("kept", F.transform(F.aggregate("g", none, take), lambda k: k["row"]))
    rows = groups.select("doc", "kept", F.explode("g").alias("g")).select("doc", "kept", "g.u.*")
    rows = rows.withColumn("other", ~F.col("stays") & ~F.col("taken") & F.array_contains("kept", F.col("row")))
    return rows.where("stays or other")
