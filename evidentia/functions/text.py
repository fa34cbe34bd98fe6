"""String functions as Column expressions; white space is ASCII white space, as Spark's regular expressions have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The claim types and the words that tell them.
CLAIM_TYPES = ("definition", "numeric", "causal", "relationship", "currentness")
_CLAIM_WORDS = (
    ("currentness", "current|outdated|deprecated|trend|recent"),
    ("causal", "causal|cause|effect|mechanism"),
    ("numeric", "numeric|numerical|number|quantity|quantitative|specification|standard"),
    ("relationship", "relation|comparison|compare"),
)
_CLAIM_NAMES = {"numeric": ("수치", "정량/기준값", "실무 예시 속 사실 주장"), "relationship": ("관계",)}
SLIDE_ERROR_TYPES = ("text_error", "numeric_unit", "visual_defect", "formula_error", "code_error")


def strip(c: Column) -> Column:
    """The text without white space at its ends, tabs and line breaks too; inner white space isn't looked at."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def compact(c: Column) -> Column:
    """Lower case, no white space at all."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def collapsed(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct words at white space, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def similar_claims(a: Column, b: Column, least: float = 0.65) -> Column:
    """One contains the other (spaces aside), or enough of the smaller token set is shared."""
    ca, cb = compact(a), compact(b)
    shared = F.size(F.array_intersect(tokens(a), tokens(b))) / F.nullif(F.least(F.size(tokens(a)), F.size(tokens(b))), F.lit(0))
    return (ca != "") & (cb != "") & (ca.contains(cb) | cb.contains(ca) | (F.coalesce(shared, F.lit(0.0)) >= least))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance per character of the longer text; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def recognised(c: Column) -> Column:
    """Recognised text made comparable: lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def text_merge(a: Column, b: Column, threshold: float = 0.83) -> Column:
    """merge, uncertain (within 0.05 below the threshold), reject, or unavailable if a side is empty."""
    a, b = recognised(F.coalesce(a, F.lit(""))), recognised(F.coalesce(b, F.lit("")))
    alike = edit_similarity(a, b)
    # Texts whose lengths differ by so much can't be alike enough; their distance isn't computed.
    most = 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), "unavailable").when(most <= threshold - 0.05, "reject").when((a == b) | (alike >= threshold), "merge").when(alike <= threshold - 0.05, "reject").otherwise("uncertain")


def without_fence(c: Column) -> Column:
    """The body of the first Markdown code fence, or the stripped text if it has none."""
    body = F.regexp_replace(F.split_part(c, F.lit("```"), F.lit(2)), r"^(?:json)?\s*", "")
    return strip(F.when(c.contains("```"), body).otherwise(c))


def first_object(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def slug(c: Column) -> Column:
    """A name that is safe in file names."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def shortened(c: Column, most: int) -> Column:
    """At most ``most`` characters, the cut marked by three dots."""
    c = collapsed(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 1))), F.lit("..."))).otherwise(c)


def sentences(c: Column) -> Column:
    """The sentences of a text: up to terminators of several scripts or a line's end.

    Texts are cut after each run of terminators and at line ends; a run that nothing precedes is no sentence. One match
    a sentence by a negated class of Latin and other characters takes Java ten times as long.
    """
    ends = "[.!?。！？]"
    found = F.filter(F.split(c, rf"(?<={ends})(?!{ends})|\n"), lambda x: ~x.rlike(rf"\A{ends}"))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """A text's lines that aren't empty, stripped."""
    return F.filter(F.transform(F.split(c, r"\n+"), strip), lambda x: x != "")


def passages(c: Column, most: int = 900) -> Column:
    """Paragraphs put together while they fit into ``most`` characters; a longer paragraph stays whole."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + 1 + F.length(x) <= most)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit("\n"), x)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(paragraphs(c), F.array().cast("array<string>"), step)


def passage_ranges(parts: Column, most: Column) -> Column:
    """``first, last, long`` of the passages that :func:`passages` makes of paragraphs: places from 1, and characters."""

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        at, long = F.coalesce(last["last"], F.lit(0)) + 1, last["long"] + 1 + F.length(x)
        on = F.struct(last["first"].alias("first"), at.alias("last"), long.alias("long"))
        new = F.struct(at.alias("first"), at.alias("last"), F.length(x).alias("long"))
        return F.when((F.size(done) > 0) & (long <= most), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(on))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(parts, F.array().cast("array<struct<first:int,last:int,long:int>>"), step)


def terms(c: Column, stop: tuple[str, ...] = ("the", "and", "of", "is", "a", "an", "to", "in"), most: int = 24) -> Column:
    """The first distinct terms of two or more letters or digits, in lower case, less stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(*stop))), 1, most)


def passage_score(passage: Column, wanted: Column) -> Column:
    """How many of the wanted terms a passage has, and half as much again for each with a digit."""
    low = F.lower(passage)
    held = F.filter(wanted, lambda t: low.contains(t))
    return F.size(held) + 1.5 * F.size(F.filter(held, lambda t: t.rlike("[0-9]")))


def bracket_mismatch(c: Column) -> Column:
    """What is wrong with a text's brackets: ``mismatch``, ``no_opener``, ``unclosed``, or null."""
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("bad"))
    closer = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.isin("(", "[", "{"), x.isin(")", "]", "}")
        fits = F.element_at(s["open"], -1) == F.element_at(closer, x)
        empty = F.size(s["open"]) == 0
        bad = F.when(closes & empty, "no_opener").when(closes & ~fits, "mismatch")
        left = F.when(opens, F.concat(s["open"], F.array(x))).when(closes & ~empty, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        return F.when(s["bad"].isNotNull(), s).otherwise(F.struct(left.alias("open"), bad.alias("bad")))

    marks = F.filter(F.split(F.regexp_replace(c, r"[^()\[\]{}]", ""), ""), lambda x: x != "")
    return F.aggregate(marks, start, step, lambda s: F.coalesce(s["bad"], F.when(F.size(s["open"]) > 0, "unclosed")))


def claim_type(c: Column) -> Column:
    """One of ``CLAIM_TYPES`` by the words in a free description; null for ``no_claim``, definition in doubt."""
    own = strip(F.coalesce(c, F.lit("")))
    low = F.lower(own)
    out = F.when(low == "no_claim", F.lit(None).cast("string")).when(low.isin(*CLAIM_TYPES), low)
    for name, words in _CLAIM_WORDS:
        out = out.when(low.rlike(words) | own.isin(*_CLAIM_NAMES.get(name, ("",))) & (own != ""), name)
    return out.otherwise("definition")


def error_type(value: Column, wrong: Column, right: Column) -> Column:
    """A slide error's type as given, or by what its texts are about."""
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    numbers = F.concat_ws(" ", wrong, right).rlike(r"(?i)[0-9]|[%℃°]|(ms|sec|kb|mb|gb|hz|khz|mhz|ghz)\b")
    return F.when(low.isin(*SLIDE_ERROR_TYPES), low).when(F.coalesce(right, F.lit("")) == "", "visual_defect").when(numbers, "numeric_unit").otherwise("text_error")


def reportable_error(wrong: Column, right: Column, reason: Column, kind: Column, style: tuple[str, ...] = ("grammar", "style", "wording", "comma", "spacing")) -> Column:
    """Whether a correction changes more than white space and isn't about style; visual ones need place and reason."""
    p, c, r = (strip(F.coalesce(x, F.lit(""))) for x in (wrong, right, reason))
    changed = (p != "") & (c != "") & (compact(p) != compact(c)) & (compact(p) != "")
    same_gaps = F.regexp_replace(p, r"\S+", "") == F.regexp_replace(c, r"\S+", "")
    styled = F.lower(r).rlike("|".join(style))
    return F.when(kind == "visual_defect", (p != "") & (r != "")).otherwise(changed & same_gaps & ~styled)


def question(kind: Column, claim: Column) -> Column:
    """A verification question for a claim of a type."""
    ask = F.when(kind == "numeric", "Is the number right: %s").when(kind == "causal", "Does the cause hold: %s").when(kind == "relationship", "Does the relation hold: %s").when(kind == "currentness", "Is it still so: %s").otherwise("Is it defined so: %s")
    return F.regexp_replace(ask, "%s", F.regexp_replace(claim, r"([\\$])", r"\\$1"))


def severity_name(severity: Column, confidence: Column) -> Column:
    """critical, major or minor; critical needs a confidence of 0.9."""
    own = F.lower(strip(F.coalesce(severity, F.lit(""))))
    return F.when((own == "critical") & (confidence < 0.9), "major").when(own.isin("critical", "major", "minor"), own).otherwise("minor")


def job_type(c: Column, default: str = "full") -> Column:
    """A job type's canonical name: hyphens as underscores, aliases resolved."""
    own = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))
    alias = F.create_map(*[F.lit(x) for x in ("video", "full", "run_video", "full", "verify", "verify_only", "run_verify", "verify_only")])
    return F.when(own == "", default).otherwise(F.coalesce(F.element_at(alias, own), own))


def final_consonant(c: Column) -> Column:
    """The index of a Hangul syllable's final consonant, 0 for none, -1 for other characters."""
    code = F.ascii(c)
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28).otherwise(-1)


def claim_key(identity: Column, context: Column, text: Column) -> Column:
    """A claim's id, or its context and the first 60 characters of its text."""
    return F.coalesce(F.nullif(identity, F.lit("")), F.concat(F.coalesce(context, F.lit("")), F.lit("::"), F.left(F.coalesce(text, F.lit("")), F.lit(60))))


def issue_identity(identity: Column, claim: Column, source: Column, place: Column, payload: Column) -> Column:
    """An issue's id, else its claim's, else its list, place and the start of its payload's sha1."""
    made = F.concat_ws(":", source, place.cast("string"), F.substring(F.sha1(payload), 1, 12))
    return F.coalesce(F.nullif(identity, F.lit("")), F.nullif(claim, F.lit("")), made)


def recogniser_artifact(snippet: Column, original: Column, corrected: Column) -> Column:
    """A snippet of six or more characters that stands in the original but not in the corrected text."""
    s, o, c = compact(snippet), compact(original), compact(corrected)
    return (F.length(s) >= 6) & o.contains(s) & ~c.contains(s)


def ngram_terms(c: Column, most_words: int = 3, most_chars: int = 28) -> Column:
    """Distinct word n-grams of up to ``most_words`` words and ``most_chars`` characters, by place, then length."""
    own = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(own) - i)), lambda n: F.array_join(F.slice(own, i + 1, n), " "))))
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(every, lambda x: F.length(x) <= most_chars)))


def domain(url: Column) -> Column:
    """A URL's host (with its port) in lower case, without ``www.``; empty if it has none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r"^www\.", "")


def visible_text(html: Column) -> Column:
    """The text of simple HTML without scripts, styles and tags; five common character references are decoded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for name, said in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(said))
    return collapsed(bare)
