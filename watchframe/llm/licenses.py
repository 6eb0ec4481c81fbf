"""Licence scans: a trained classifier of paragraphs, an unknown class, and template comparison.

A text falls into paragraphs at blank lines, the units that are classified, and a paragraph, its line ends
taken as spaces, into sentences. The model is a sparse softmax regression over words and word pairs with one
class for each licence family, one for licences that it does not know and one for other text. It is trained in
numpy on variations of the notices below and on a bounded sample of the corpus's own sentences. Its few weights
are literals of one DataFrame expression, and the paragraphs of every text are scored in place: no Python runs on
the executors and nothing is shuffled.

What a paragraph says of licences are its sentences with an anchor (ANCHORS: words without which no notice is
written) that grant something (GRANTS) or are no longer than a heading; a clause that denies a licence ("not
under version 3", up to the next comma) is cut out first, "not only" denies nothing. Paragraphs without such a
sentence are other text. A family is named where it is likely enough against `unknown` and other text, as calibrated,
and its template comparison agrees for one of the sentences: enough of a template's word pairs stand in it, all
words that the family requires (its version among them) do, and none that it excludes (`lesser` for the GPL).
Of alternatives ("GPL-2.0 or MIT") each is read as a grant of its own. Paragraphs that speak of a licence but confirm no
family are `unknown`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, UNKNOWN = "other", "unknown"


def _gnu(name: str, short: str, version: str) -> list[str]:
    return [
        f"gnu {name} version {version}",
        f"{short} version {version}",
        f"spdx-license-identifier {short} version {version}",
        f"under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version",
        f"this work is licensed under the gnu {name} version {version}",
        f"{name} version {version}",
    ]


def _cc(words: str, short: str) -> list[str]:
    return [
        f"cc {short} 4",
        f"licensed under a creative commons {words} 4 international license",
        f"creative commons {words} 4",
        f"{words} 4 international",
        f"licensed under cc {short} 4",
        f"spdx-license-identifier cc {short} 4",
    ]


#: Fixed values: (words or pairs that a notice must hold, `|` between those of which one is enough; words that it must not; notices as they are usually written,
#: in the spelling of `normal`).
FAMILIES = {
    "agpl-3.0": (["affero|agpl", "version 3"], ["lesser"], _gnu("affero general public license", "agpl", "3")),
    "apache-1.1": (["apache", "1.1"], [], ["apache software license version 1.1", "licensed under the apache license version 1.1", "spdx-license-identifier apache 1.1"]),
    "apache-2.0": (["apache", "2"], [], ["licensed under the apache license version 2", "apache license 2", "apache license version 2", "spdx-license-identifier apache 2", "licensed under apache 2"]),
    "artistic-2.0": (["artistic", "2"], [], ["artistic license 2", "licensed under the artistic license version 2", "spdx-license-identifier artistic 2"]),
    "bsd": ([], ["3-clause", "2-clause"], ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "licensed under a bsd license"]),
    "bsd-2-clause": ([], ["3-clause"], ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "spdx-license-identifier bsd 2-clause"]),
    "bsd-3-clause": ([], ["2-clause"], ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "spdx-license-identifier bsd 3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"]),
    "bsl-1.0": (["boost|bsl"], [], ["distributed under the boost software license version 1", "boost software license", "spdx-license-identifier bsl 1 boost"]),
    "cc-by-4.0": (["4"], ["by-nc", "by-sa", "by-nd", "noncommercial", "sharealike", "noderivatives", "by-nc-sa", "by-nc-nd"], _cc("attribution", "by")),
    "cc-by-nc-4.0": (["by-nc|noncommercial", "4"], ["by-nc-sa", "by-nc-nd", "sharealike", "noderivatives"], _cc("attribution noncommercial", "by-nc")),
    "cc-by-nc-nd-4.0": (["by-nc-nd|noncommercial", "by-nc-nd|noderivatives", "4"], ["sharealike"], _cc("attribution noncommercial noderivatives", "by-nc-nd")),
    "cc-by-nc-sa-4.0": (["by-nc-sa|noncommercial", "by-nc-sa|sharealike", "4"], ["noderivatives"], _cc("attribution noncommercial sharealike", "by-nc-sa")),
    "cc-by-nd-4.0": (["by-nd|noderivatives", "4"], ["noncommercial", "by-nc-nd"], _cc("attribution noderivatives", "by-nd")),
    "cc-by-sa-4.0": (["by-sa|sharealike", "4"], ["noncommercial", "by-nc-sa"], _cc("attribution sharealike", "by-sa")),
    "cc0-1.0": (["cc0|zero"], [], ["cc0 1 universal", "cc0 1", "cc0 1 universal public domain dedication", "dedicated to the public domain under cc0", "spdx-license-identifier cc0 1", "creative commons zero cc0 1 universal"]),
    "epl-2.0": (["eclipse|epl", "2"], [], ["epl 2", "epl 2 license", "made available under the terms of the eclipse public license 2", "eclipse public license version 2", "spdx-license-identifier epl 2"]),
    "gpl-2.0": (["version 2"], ["lesser", "library", "affero", "lgpl", "agpl"], _gnu("general public license", "gpl", "2")),
    "gpl-3.0": (["version 3"], ["lesser", "library", "affero", "lgpl", "agpl"], _gnu("general public license", "gpl", "3")),
    "isc": ([], [], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "isc license", "spdx-license-identifier isc"]),
    "lgpl-2.1": (["lesser|lgpl", "version 2.1"], ["affero", "agpl"], _gnu("lesser general public license", "lgpl", "2.1")),
    "lgpl-3.0": (["lesser|lgpl", "version 3"], ["affero", "agpl"], _gnu("lesser general public license", "lgpl", "3")),
    "mit": ([], [], ["released under the mit license", "mit license", "licensed under mit", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    "mpl-1.1": (["mozilla|mpl", "1.1"], [], ["mpl 1.1", "mozilla public license version 1.1", "subject to the mozilla public license version 1.1", "spdx-license-identifier mpl 1.1"]),
    "mpl-2.0": (["mozilla|mpl", "2"], [], ["mpl 2", "mpl 2 license", "this source code form is subject to the terms of the mozilla public license version 2", "mozilla public license version 2", "mozilla public license 2", "spdx-license-identifier mpl 2"]),
    "unlicense": (["unlicense"], [], ["released under the unlicense", "spdx-license-identifier unlicense", "the unlicense"]),
    "wtfpl": ([], [], ["do what the fuck you want to public license", "licensed under the wtfpl", "spdx-license-identifier wtfpl"]),
    "zlib": (["zlib"], [], ["released under the zlib license", "zlib license", "spdx-license-identifier zlib"]),
}
#: A sentence of none of these is not classified.
ANCHORS = r"licen[sc]|spdx|gpl|(?<![a-z])[me]pl(?![a-z])|creative commons|(?<![a-z])cc[ -]?(?:by|0|zero)|attribution|public domain|permission (?:is hereby|to use)|redistribution and use|wtfpl|to endorse or promote"
#: Parts of text that every text with an anchor holds: the quick look before texts are cut up.
_STEMS = ("licen", "spdx", "gpl", "mpl", "epl", "creative commons", "cc by", "cc-by", "ccby", "cc0", "cc 0", "cc-0", "cc zero", "cc-zero", "cczero", "attribution", "public domain", "permission ", "permission\n", "redistribution", "creative\n", "wtfpl", "endorse", "public\n")
#: A clause that denies a licence, up to the next comma or `but`.
DENIAL = r"(?<![a-z])(?:not|never|neither|nor|no longer|isn't|aren't|wasn't|cannot be|can't be)(?! only)(?: [a-z]+){0,2} (?:licensed|released|distributed|available|covered|published|provided|offered|under|subject to)(?![a-z])(?:(?! but )[^,;:()])*"
#: Words that grant something, and what else only notices say; and the words of a heading at most.
GRANTS = r"(?<![a-z])(?:re-?licen[sc]ed|licen[sc]ed|released|distributed?|redistributed?|available|covered|provided|published|offered|permitted|granted|dedicated|governed|redistribution|permission|spdx-license-identifier|under|subject to|terms|used?|applies|endorse)(?![a-z])"
HEADING_WORDS = 9
#: Words that say nothing about a licence.
STOP_WORDS = "a an and any are as at be for from in is it of on or that the this to was with you".split()
_WORD = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"
#: How a licence's name begins.
NAMES = r"(?:mit|apache|[la]?gpl|gnu|bsd|[23]-clause|simplified|mpl|mozilla|epl|eclipse|isc|cc0?|creative commons|unlicense|zlib|wtfpl|boost|bsl|artistic)(?![a-z])"
#: (pattern, replacement), in this order: one spelling for each name and version.
SPELLINGS = [
    (r"\s+", " "),
    ("licence", "license"),
    (r"(?<![a-z])(spdx-license-identifier):", "$1"),
    (r"share-?alike|share alike", "sharealike"),
    (r"non-?commercial|non commercial", "noncommercial"),
    (r"no-?deriv(?:ative)?s?(?![a-z])|no derivatives", "noderivatives"),
    (r"attribution-", "attribution "),
    (r"noncommercial-", "noncommercial "),
    (r"(?<![a-z])cc[ -]?(by(?:-[a-z]{2})*|zero)[ -]?(?=[0-9]|(?![a-z]))", "cc $1 "),
    (r"(?<![a-z])(apache|bsd|mpl|epl|artistic|bsl|cc0)[ -](?=[0-9])", "$1 "),
    (r"(?<![a-z])([la]?gpl)[ -]?(?:v(?:ersion|er)?\.? ?)?(?=[0-9])", "$1 version "),
    (r"(?<![a-z])v(?:er|\.)? ?(?=[0-9])", "version "),
    (r"(?<![0-9.])([0-9])\.0(?:-only|-or-later)?(?![0-9.]*[0-9])", "$1"),
    (r"([0-9])-(?:only|or-later)", "$1"),
    (r"(?<![a-z])two-clause", "2-clause"),
    (r"(?<![a-z])three-clause", "3-clause"),
    (r"public license,? v ", "public license version "),
    # alternatives: each has the grant of the first; twice, for three of them
    (rf"((?:(?:licensed|released|distributed|available|offered|published|provided|used?) under|spdx-license-identifier)[^;]*?),? (?:and/or|or|and) (?:under )?(?:the |a )?(?={NAMES})", "$1 or licensed under "),
    (rf"(or licensed under [^;]*?),? (?:and/or|or|and) (?:under )?(?:the |a )?(?={NAMES})", "$1 or licensed under "),
]
PARAGRAPH = r"\n[ \t\r]*\n\s*"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z\"'(*#])"
#: Most documents whose sentences are sampled as other text, most bytes of one of them, and most sentences.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 100_000
TRAIN_SENTENCES = 6_000
#: Least share of a template's word pairs that a sentence must hold.
CONFIRM = 0.6
#: Weights below this are dropped.
LEAST_WEIGHT = 0.02


def normal(text: str) -> str:
    """The one spelling in which notices are compared."""
    text = text.lower()
    for pattern, other in SPELLINGS:
        text = re.sub(pattern, other.replace("$", "\\"), text)
    return text


def words_of(text: str) -> list[str]:
    return [w for w in re.findall(_WORD, text) if w not in STOP_WORDS]


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def grams(text: str) -> set[str]:
    words = words_of(text)
    return {*words, *pairs_of(words)}


class Model:
    """classes, non-zero weights of each gram, bias, and the likelihood that a family needs."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], least: float):
        self.classes, self.weights, self.bias, self.least = classes, weights, bias, least


def _unlike(rng, plain: list[str]) -> tuple[list[str], list[str]]:
    """Sentences on licences that no family has, and sentences with the words of licences that name none."""
    names = [w for p in plain[:400] for w in re.findall(r"[a-z]{4,9}", p.lower())] or ["foobar", "example", "sample"]
    pick = lambda: names[rng.integers(len(names))]
    forms = ["licensed under the {0} license version {1}", "released under the {0} {2} public license", "this software is covered by the {0} license agreement", "the {0} software license {1} applies", "subject to the terms of the {0} public license version {1}", "spdx-license-identifier {0} {1}", "all code is under the {0} {2} license"]
    unknown = [f.format(pick(), rng.integers(1, 9), pick()) for f in forms for _ in range(20)]
    unknown += ["licensed under the gnu license", "licensed under the general public license", "this license covers nothing", "see the license file", "gpl version 1", "cc by-sa 3", "creative commons attribution 3 unported license", "eclipse public license version 1", "apache license", "all use is subject to the license", "creative commons license", "attribution required"] * 4
    forms = ["the {0} license was issued in {1}", "he lost his driving license near the {0}", "a license to {0} the {2}", "the general public liked version {1} of the {0}", "permission to use the {0} was refused", "attribution of the {0} to the {2}", "the {0} entered the public domain in {1}", "version {1} of the {0}", "all rights reserved {0}"]
    return unknown, [f.format(pick(), rng.integers(1, 9), pick()) for f in forms for _ in range(20)]


def train(plain: list[str], rounds: int = 300, rate: float = 2.0, l1: float = 2e-5, seed: int = 1) -> Model:
    """Softmax regression by proximal gradient steps (L1 keeps it sparse). plain: sentences of other text."""
    rng = np.random.default_rng(seed)
    classes = [*FAMILIES, UNKNOWN, OTHER]
    plain = [normal(p) for p in plain if not re.search(ANCHORS, p.lower())]
    unknown, harmless = _unlike(rng, plain)
    rows = []
    for k, name in enumerate(FAMILIES):
        needed, _, notices = FAMILIES[name]
        needed = {w for x in needed for w in re.split(r"[ |]", x)}
        for notice in notices:
            words = notice.split()
            rows.append((words, k))
            for _ in range(8):  # words that tell no version may be missing, and plain text may stand around
                kept = [w for w in words if w in needed or len(words) < 6 or rng.random() > 0.06]
                around = plain[rng.integers(len(plain))].split()[:6] if plain else []
                rows.append((around + kept if rng.random() < 0.5 else kept + around, k))
    rows += [(t.split(), len(classes) - 2) for t in unknown] + [(t.split(), len(classes) - 1) for t in plain + harmless]
    sets = [grams(" ".join(w)) for w, _ in rows]
    known = set().union(*(g for g, (_, k) in zip(sets, rows, strict=True) if k < len(FAMILIES)))
    known &= set().union(*(grams(t) for _, _, ts in FAMILIES.values() for t in ts))
    # and what is usual around licences that no family has, and around the word in other text
    times = Counter(g for t in unknown + harmless for g in grams(t))
    known |= {g for g, n in times.items() if n >= 10}
    names = sorted(known)
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, g in enumerate(sets):
        x[i, [at[w] for w in g if w in at]] = 1
    truth = np.array([k for _, k in rows])
    y = np.eye(len(classes), dtype=np.float32)[truth]
    fit = np.arange(len(rows)) % 5 != 0
    share = np.maximum(y[fit].mean(0), 1e-9)
    # every class weighs as much as its root, so that rare families are not drowned by other text
    weight = (1 / np.sqrt(share))[truth[fit]][:, None]
    weight /= weight.mean()
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[-1] = 2.0
    xf, yf = x[fit], y[fit]
    for _ in range(rounds):
        z = xf @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - yf) * weight / len(yf)
        w -= rate * (xf.T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    likely = _likelihoods(x[~fit] @ w + b)
    family = truth[~fit] < len(FAMILIES)
    own = likely[np.flatnonzero(family), truth[~fit][family]]
    false = likely[~family].max(1) if (~family).any() else np.zeros(1)
    # between what true notices reach and what other text and other licences reach, calibrated on rows kept out
    least = (float(np.quantile(own, 0.05)) + float(np.quantile(false, 0.95))) / 2 if len(own) else 0.5
    weights = {g: [float(v) for v in np.round(w[i], 4)] for g, i in at.items() if np.abs(w[i]).max() >= LEAST_WEIGHT}
    return Model(classes, weights, [float(v) for v in np.round(b, 4)], min(max(least, 0.2), 0.9))


def _likelihoods(z: np.ndarray) -> np.ndarray:
    """Of each family against `unknown` and other text alone: two families of one sentence may both be likely."""
    rest = np.logaddexp(z[:, -1], z[:, -2])[:, None]
    return 1 / (1 + np.exp(np.clip(rest - z[:, :-2], -60, 60)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, sentences: int = TRAIN_SENTENCES) -> Model:
    """Model whose other text is drawn from `most` rows of at most `most_bytes` bytes, those of least hash.

    Of all their sentences, wherever they stand, the `sentences` of least hash over id, place and text are
    taken. These three bounds hold for training only; the scan reads every text whole.
    """
    key, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.where(F.octet_length(text) <= most_bytes).select(key.alias("i"), text.alias("t"))
    # ids first, so that only the chosen rows' texts are read into the sample; then rows, as ids may repeat
    order = [F.xxhash64("i", F.lit(1)), "i"]
    rows = rows.join(F.broadcast(rows.select("i").distinct().orderBy(*order).limit(most)), "i").orderBy(*order, F.xxhash64("t")).limit(most)
    parts = F.flatten(F.transform(F.split("t", PARAGRAPH, -1), lambda p: F.split(p, SENTENCE, -1)))
    rows = rows.select("i", F.posexplode(parts).alias("k", "p")).where(F.col("p").rlike(r"(?U)\S"))
    rows = rows.orderBy(F.xxhash64("i", "k", "p"), "i", "k", "p").limit(sentences)
    return train([r["p"] for r in rows.select("p").collect()])


def license_scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices of each row: id_col, n_paragraphs, n_notices, families, notices.

    notices: array of (paragraph from 0, family or `unknown`, likelihood, coverage of its template), by
    paragraph, then family; a family counts once in a paragraph. families: the confirmed ones, sorted, joined by
    commas. Null, empty and blank texts have no paragraph. Texts are read whole, however long they are.
    Rows keep their number, repeated and null ids too; other columns, whatever their names, are not read;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    families = model.classes[:-2]
    vocabulary = sorted(model.weights)
    width = len(model.classes)
    signs = F.split(F.lit("\n".join(vocabulary)), "\n")
    table = F.lit(np.array([v for g in vocabulary for v in model.weights[g]], np.float64))
    bias = F.lit(np.array(model.bias, np.float64))

    def words(t):
        return F.filter(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))

    def with_pairs(ws):
        pairs = F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.size(ws) + 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(ws, pairs))

    def spelled(t):
        t = F.lower(t)
        for pattern, other in SPELLINGS:
            t = F.regexp_replace(t, pattern, other)
        return t

    def logits(own):
        held = F.array_intersect(own, signs)
        add = lambda acc, g: F.zip_with(acc, F.slice(table, (F.array_position(signs, g).cast("int") - 1) * width + 1, F.lit(width)), lambda u, v: u + v)
        return F.aggregate(held, bias, add)

    def confirmed(own, name):
        needed, barred, notices = FAMILIES[name]
        covers = [_share(own, pairs_of(words_of(n)) or words_of(n)) for n in notices]
        cover = F.greatest(*covers) if len(covers) > 1 else covers[0]
        ok = cover >= CONFIRM
        for w in needed:
            ok = ok & F.arrays_overlap(own, F.array(*[F.lit(x) for x in w.split("|")]))
        for w in barred:
            ok = ok & ~F.array_contains(own, w)
        return F.when(ok, cover)

    def judged(s):
        """Named families of a paragraph (struct i, owns: grams of each sentence, z: logits of all), or `unknown`."""
        z = s["z"]
        covered = lambda n: F.array_max(F.transform(s["owns"], lambda own: confirmed(own, n)))
        top = F.greatest(z[width - 2], z[width - 1])
        rest = top + F.log(F.exp(z[width - 2] - top) + F.exp(z[width - 1] - top))
        found = [F.struct(s["i"].alias("paragraph"), F.lit(n).alias("family"), F.round(1 / (1 + F.exp(rest - z[k])), 6).alias("likelihood"), F.round(covered(n), 6).alias("coverage")) for k, n in enumerate(families)]
        named = F.filter(F.array(*found), lambda f: f["coverage"].isNotNull() & (f["likelihood"] >= model.least))
        best = F.array_max(F.slice(z, F.lit(1), F.lit(width - 1)))
        none = F.struct(s["i"].alias("paragraph"), F.lit(UNKNOWN).alias("family"), F.round(1 / (1 + F.exp(z[width - 1] - best)), 6).alias("likelihood"), F.lit(0.0).alias("coverage"))
        return F.when(F.size(named) > 0, named).when(best > z[width - 1], F.array(none)).otherwise(F.array().cast("array<struct<paragraph:int,family:string,likelihood:double,coverage:double>>"))

    # a quick look at the whole text; only texts with an anchor are cut into sentences
    low = F.lower(text)
    may = F.lit(False)
    for stem in _STEMS:
        may = may | F.contains(low, F.lit(stem))
    paragraphs = F.when(text.rlike(r"\S"), F.split(F.trim(text), PARAGRAPH, -1)).otherwise(F.array().cast("array<string>"))
    n_paragraphs = F.when(text.rlike(r"\S"), F.regexp_count(F.trim(text), F.lit(PARAGRAPH)) + 1).otherwise(0)
    clause = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), DENIAL, " ")
    speaks = lambda x: x.rlike(ANCHORS) & (x.rlike(GRANTS) | (F.size(F.split(F.trim(x), " +")) <= HEADING_WORDS))
    likely = F.transform(paragraphs, lambda p, i: F.struct(i.cast("int").alias("i"), F.filter(F.transform(F.split(p, SENTENCE, -1), clause), speaks).alias("said")))
    told = F.transform(F.filter(likely, lambda x: F.size(x["said"]) > 0), lambda x: F.struct(x["i"].alias("i"), F.transform(x["said"], lambda s: with_pairs(words(spelled(s)))).alias("owns")))
    scored = F.transform(told, lambda x: F.struct(x["i"].alias("i"), x["owns"].alias("owns"), logits(F.array_distinct(F.flatten(x["owns"]))).alias("z")))
    notices = F.when(may, F.flatten(F.transform(scored, judged))).otherwise(F.array().cast("array<struct<paragraph:int,family:string,likelihood:double,coverage:double>>"))
    rows = docs.select(F.col(id_col), n_paragraphs.alias("n_paragraphs"), notices.alias("notices"))
    named = F.array_sort(F.array_distinct(F.filter(F.col("notices.family"), lambda f: f != UNKNOWN)))
    return rows.select(id_col, "n_paragraphs", F.size("notices").alias("n_notices"), F.array_join(named, ",").alias("families"), "notices")


def _share(own, wanted: list[str]):
    """Share of the wanted words or pairs among a sentence's own."""
    wanted = list(dict.fromkeys(wanted))
    return F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in wanted]))) / len(wanted)
