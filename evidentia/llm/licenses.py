"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

The main path is DataFrame functions only. A text is rewritten to its words, each between two spaces of its own
(`` under  the  mit  license ``), so rules match whole words, neighbouring matches never share a character, and a
place in words is half the number of spaces before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels of the base.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License families as label, names (words; | parts alternatives) and versions (words; empty: unversioned).
FAMILIES = (
    ("mit", "mit|expat", ""),
    ("apache", "apache|apache software", "1 0|1 1|2 0|2"),
    ("gpl", "gnu general public|gnu gpl|gpl", "1|2|3|2 0|3 0"),
    ("lgpl", "gnu lesser general public|gnu library general public|lgpl", "2|2 1|3|3 0"),
    ("agpl", "gnu affero general public|affero general public|agpl", "1|3|3 0"),
    ("fdl", "gnu free documentation|gfdl", "1 1|1 2|1 3"),
    ("bsd", "bsd|berkeley software distribution", ""),
    ("bsd-2", "2 clause bsd|bsd 2 clause|simplified bsd|freebsd", ""),
    ("bsd-3", "3 clause bsd|bsd 3 clause|new bsd|modified bsd", ""),
    ("mpl", "mozilla public|mpl", "1 0|1 1|2 0"),
    ("epl", "eclipse public|epl", "1 0|2 0"),
    ("eupl", "european union public|eupl", "1 1|1 2"),
    ("cddl", "common development and distribution|cddl", "1 0|1 1"),
    ("cpl", "common public|cpl", "1 0"),
    ("osl", "open software|osl", "1 0|2 1|3 0"),
    ("afl", "academic free|afl", "2 1|3 0"),
    ("artistic", "artistic", "1 0|2 0"),
    ("isc", "isc", ""),
    ("zlib", "zlib|zlib libpng", ""),
    ("boost", "boost software|bsl", "1 0"),
    ("ofl", "sil open font|ofl", "1 0|1 1"),
    ("odbl", "open database|odbl", "1 0"),
    ("python", "python software foundation|psf", "2"),
    ("postgresql", "postgresql", ""),
    ("openssl", "openssl", ""),
    ("php", "php", "3 0|3 01"),
    ("ruby", "ruby", ""),
    ("zope", "zope public|zpl", "2 0|2 1"),
    ("ncsa", "university of illinois ncsa open source|ncsa", ""),
    ("ms-pl", "microsoft public|ms pl", ""),
    ("ms-rl", "microsoft reciprocal|ms rl", ""),
    ("qpl", "q public|qpl", "1 0"),
    ("unicode", "unicode", ""),
    ("w3c", "w3c software|w3c", ""),
    ("wtfpl", "do what the fuck you want to public|wtfpl", "2"),
    ("unlicense", "unlicense", ""),
    ("bsl", "business source|busl", "1 1"),
    ("sspl", "server side public|sspl", "1"),
    ("cecill", "cecill", "1 0|2 0|2 1"),
    ("vim", "vim", ""),
)
# Creative Commons terms and versions.
CC_TERMS = (("by", "attribution"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivs"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivs"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Sentences of license texts and of their notices as label, keyword and words.
BODIES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("boost-1", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "without fee", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", "binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl-2", "free software", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "free software", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "free software", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "free software", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "affero", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("fdl-1.3", "documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("wtfpl-2", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("cc0-1", "public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("proprietary", "strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
)
#: Tiers in falling priority and the confidence of a detection.
SPDX, BODY, GRANT, VERSIONED, NAMED, HINT = range(6)
CONFIDENCE = (1.0, 0.98, 0.95, 0.9, 0.7, 0.3)
#: Confidence of a base phrase.
BASE_CONFIDENCE = 0.9
_BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GRANT = "licensed|released|distributed|available|provided|published|covered|governed"


@dataclass(frozen=True)
class Rule:
    """A pattern over wrapped words; it is tried only if ``keyword`` (wrapped words too) stands in the text."""

    tier: int
    label: str
    keyword: str
    pattern: str


def wrapped(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def rules() -> list[Rule]:
    """The signatures in order: by tier, then longer patterns first, then as the families stand."""
    out = []
    for label, names, versions in FAMILIES:
        for name in names.split("|"):
            keyword = wrapped(name)
            bare = keyword + "(?: license | licence )?"
            out.append(Rule(GRANT, label, keyword, f" (?:{_GRANT})  under (?: the )?(?: terms  of  the )?{bare}"))
            if name != label or name.split()[-1] not in ("mit", "isc", "php", "ruby", "vim", "unicode", "python", "artistic"):
                out.append(Rule(NAMED, label, keyword, f"{keyword}(?: license | licence )"))
            else:
                out.append(Rule(NAMED, label, keyword, f"{keyword} license "))
            for version in filter(None, versions.split("|")):
                own = f"{label}-{version.removesuffix(' 0').replace(' ', '.')}"
                said = f"(?: version | v )?{wrapped(version)}"
                out.append(Rule(VERSIONED, own, keyword, f"{bare}{said}"))
                out.append(Rule(GRANT, own, keyword, f" (?:{_GRANT})  under (?: the )?(?: terms  of  the )?{bare}{said}"))
                out.append(Rule(SPDX, own, " spdx ", f" spdx  license  identifier {keyword}{wrapped(version)}"))
        out.append(Rule(SPDX, label, " spdx ", f" spdx  license  identifier {wrapped(label.replace('-', ' '))}"))
    for (short, long), version in product(CC_TERMS, ("", *CC_VERSIONS)):
        label = "cc-" + short.replace(" ", "-") + (f"-{version.removesuffix(' 0').replace(' ', '.')}" if version else "")
        tier = VERSIONED if version else NAMED
        out.append(Rule(tier, label, " cc ", f" cc {wrapped(short)}{wrapped(version)}"))
        out.append(Rule(tier, label, " creative ", f" creative  commons {wrapped(long)}(?: license )?{wrapped(version)}"))
    out += [Rule(BODY, label, wrapped(keyword), wrapped(words)) for label, keyword, words in BODIES]
    out += [
        Rule(VERSIONED, "cc0-1", " cc0 ", " cc0 (?: 1  0 )?"),
        Rule(NAMED, "public-domain", " domain ", " (?:dedicated|released|placed)  (?:to|into|in)  the  public  domain "),
        Rule(HINT, "proprietary", " rights ", " all  rights  reserved "),
        Rule(HINT, "unknown", " license ", f" (?:{_GRANT})  under "),
    ]
    return sorted(dict.fromkeys(out), key=lambda r: (r.tier, -len(r.pattern)))


def _count(wrapped_words: Column) -> Column:
    return ((F.length(wrapped_words) - F.length(F.replace(wrapped_words, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(norm: Column, pattern: Column) -> Column:
    """Where a pattern's matches start and end, in words: ``array<struct<lo:int,hi:int>>``."""
    pieces, texts = F.split(norm, pattern), F.regexp_extract_all(norm, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(texts)), texts, lambda p, t: F.struct(_count(p).alias("gap"), _count(t).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        return F.struct((lo + x["own"]).alias("at"), F.concat(acc["done"], F.array(F.struct(lo.alias("lo"), (lo + x["own"]).alias("hi")))).alias("done"))

    return F.aggregate(pairs, start, step)["done"]


def _uncontained(hits: Column) -> Column:
    """The hits that no range of an earlier rule contains, by start.

    One sweep by start, longer ranges first, so all that may contain a hit stand before it. The sweep keeps, of the
    rules met so far, the furthest end of each that no earlier rule reaches: as many entries as rules at most.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["lo"].alias("lo"), (-h["hi"]).alias("back"), h["nr"].alias("nr"), h["tier"].alias("tier"), h["label"].alias("label"))))
    start = F.struct(F.array().cast("array<struct<nr:int,hi:int>>").alias("front"), F.array().cast("array<struct<nr:int,tier:int,label:string,lo:int,hi:int>>").alias("left"))

    def step(s: Column, h: Column) -> Column:
        hi = -h["back"]
        over = F.exists(s["front"], lambda f: (f["nr"] < h["nr"]) & (f["hi"] >= hi))
        known = F.exists(s["front"], lambda f: (f["nr"] <= h["nr"]) & (f["hi"] >= hi))
        front = F.concat(F.filter(s["front"], lambda f: (f["nr"] < h["nr"]) | (f["hi"] > hi)), F.array(F.struct(h["nr"].alias("nr"), hi.alias("hi"))))
        own = F.array(F.struct(h["nr"].alias("nr"), h["tier"].alias("tier"), h["label"].alias("label"), h["lo"].alias("lo"), hi.alias("hi")))
        return F.struct(F.when(known, s["front"]).otherwise(front).alias("front"), F.when(over, s["left"]).otherwise(F.concat(s["left"], own)).alias("left"))

    return F.aggregate(order, start, step)["left"]


def _gate(phrases: list[str]) -> str:
    """A pattern for lower-cased texts that have any of the phrases; no rule matches without its keyword."""
    by: dict[str, list[str]] = {}
    for phrase in sorted({tuple(p.split()) for p in phrases}):
        by.setdefault(phrase[0][0], []).append(f"{_BLANK}+".join(phrase)[1:])
    return f"(?:^|{_BLANK})(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + f")(?:{_BLANK}|$)"


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, base, hits`` for each row.

    ``base`` lists each base phrase's places, ``hits`` the detections left over: ``array<struct<tier,label,lo,hi>>``,
    word ranges ``[lo, hi)``. Of two detections the later rule's goes if the earlier one's range contains it; equal
    ranges of one tier stay with the rule that is listed first. A text is read whole; only texts with a
    rule's keyword or a base phrase are rewritten and only rules whose keyword stands in the text are tried. Null texts are empty,
    repeated rows are judged alike, an empty table gives no rows.
    """
    signatures = rules() if signatures is None else signatures
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gate = F.lower(text).rlike(_gate([r.keyword for r in signatures] + [phrase for phrase, _ in BASE]))
    folded = F.translate(text, ascii_uppercase, ascii_lowercase)
    norm = F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")), F.lit(" ")))
    docs = docs.select("doc_id", F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), norm.alias("norm"))

    words = sorted({r.keyword for r in signatures})
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.col("norm").contains(w))
    docs = docs.withColumn("found", F.when(F.col("norm").isNotNull(), found))
    table = F.array(*[F.struct(F.lit(k).alias("nr"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for k, r in enumerate(signatures)])
    tried = F.filter(table, lambda r: F.array_contains(F.col("found"), r["keyword"]))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(_places(F.col("norm"), r["pattern"]), lambda p: F.struct(r["nr"].alias("nr"), r["tier"].alias("tier"), r["label"].alias("label"), p["lo"].alias("lo"), p["hi"].alias("hi")))))
    docs = docs.withColumn("hits", F.when(F.size("found") > 0, hits))
    left = _uncontained(F.col("hits"))
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.transform(_places(F.col("norm"), F.lit(wrapped(phrase))), lambda p: p["lo"]).alias("at")) for phrase, label in BASE])
    empty = "array<struct<nr:int,tier:int,label:string,lo:int,hi:int>>"
    return docs.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), base).otherwise(F.array().cast("array<struct<label:string,at:array<int>>>")).alias("base"), F.coalesce(left, F.array().cast(empty)).alias("hits"))


def labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    The score is the highest confidence of the detections and base phrases that are left, 0 without any.
    """
    at = F.flatten(F.transform("base", lambda b: b["at"]))
    own = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    confidence = F.array(*[F.lit(c) for c in CONFIDENCE])
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("hits", lambda h: F.get(confidence, h["tier"]))))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform("hits", lambda h: h["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.size(own) > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
    )
