"""Answers of models and other loose JSON brought to one form, and edits of texts that such answers ask for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.numbers import clamp01, model_score
from evidentia.functions.text import final_consonant, without_fence

#: Judgments, stances and the names that fields of a passage go by.
JUDGMENTS = ("valid_issue", "partially_resolved", "not_issue", "insufficient_context")
STANCES = ("supports_issue", "refutes_issue", "insufficient_evidence")
PASSAGE_FIELDS = {
    "url": ("url", "source", "source_url"),
    "quote": ("quote_or_paragraph", "passage", "paragraph", "quote", "text"),
    "key_sentence": ("key_sentence", "sentence"),
    "stance": ("stance", "status", "supports"),
    "reason": ("why_relevant", "reason"),
}
#: Particles after a syllable with and without a final consonant.
PARTICLES = (("을", "를"), ("은", "는"), ("이", "가"), ("과", "와"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def judgment(payload: Column) -> Column:
    """A reviewer's JSON as a struct: unknown judgments are ``insufficient_context``, what isn't a number counts 0."""
    said = _filled(F.get_json_object(payload, "$.judgment"))
    valid, severity, resolved = (clamp01(F.get_json_object(payload, f"$.{n}")) for n in ("is_valid_issue", "category_severity", "context_resolution"))
    unresolved = clamp01(1 - resolved)
    return F.struct(
        F.when(said.isin(*JUDGMENTS), said).otherwise("insufficient_context").alias("judgment"),
        valid.alias("valid"),
        severity.alias("severity"),
        unresolved.alias("unresolved"),
        model_score(valid, severity, unresolved).alias("score"),
        F.coalesce(F.trim(F.get_json_object(payload, "$.reason")), F.lit("")).alias("reason"),
    )


def passages(payload: Column) -> Column:
    """Evidence passages from JSON, one object or a list of them, fenced or not: fields by any of their names, ids made up.

    What can't be read is an empty array; unknown stances are ``insufficient_evidence``.
    """
    body = without_fence(payload)
    rows = F.from_json(F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), "array<map<string,string>>")
    rows = F.coalesce(rows, F.array().cast("array<map<string,string>>"))

    def one(row: Column, i: Column) -> Column:
        named = {n: F.coalesce(*[_filled(F.try_element_at(row, F.lit(k))) for k in ks], F.lit("")) for n, ks in PASSAGE_FIELDS.items()}
        named["stance"] = F.when(named["stance"].isin(*STANCES), named["stance"]).otherwise("insufficient_evidence")
        made = F.coalesce(_filled(F.try_element_at(row, F.lit("id"))), F.concat(F.lit("E"), (i + 1).cast("string")))
        return F.struct(made.alias("id"), *[c.alias(n) for n, c in named.items()])

    return F.transform(F.filter(rows, lambda r: r.isNotNull()), one)


def corrections(payload: Column) -> Column:
    """Corrections ``index, text, decision`` from a fenced JSON answer, without those that lack an index or text; the last of an index counts."""
    kind = "corrections array<struct<index int, text string, decision string>>"
    rows = F.coalesce(F.from_json(without_fence(payload), kind)["corrections"], F.array().cast("array<struct<index int, text string, decision string>>"))
    rows = F.filter(rows, lambda r: r["index"].isNotNull() & (F.coalesce(r["text"], F.lit("")) != ""))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda x: x["index"] == r["index"]))
    return F.transform(last, lambda r: F.struct(r["index"].alias("index"), r["text"].alias("text"), F.lower(F.trim(F.coalesce(r["decision"], F.lit("")))).alias("decision")))


def directional(status: Column) -> tuple[Column, Column]:
    """The claim's verdict and whether the issue holds, from a status that has a direction; nulls from others."""
    return F.when(status == "supports_issue", "claim_false").when(status == "refutes_issue", "claim_true"), F.when(status.isin("supports_issue", "refutes_issue"), status == "supports_issue")


def pair_rank(asked: Column, decision: Column, merge: Column) -> Column:
    """How much a pair's result is preferred, from 6 down to 0."""
    built = decision.isin("same_slide_build", "same_slide_annotation")
    copied = decision == "same_slide_duplicate"
    return (
        F.when(merge & built & (asked == "same_slide_build"), 6)
        .when(merge & copied & (asked == "same_slide_duplicate"), 5)
        .when(merge & built, 4)
        .when(merge & copied, 3)
        .when(decision == "different_slide", 2)
        .when(decision == "uncertain", 1)
        .otherwise(0)
    )


def loose_number(payload: Column, path: str) -> Column:
    """A JSON number at a path; null for texts, booleans and what isn't there or can't be read."""
    found = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    return F.when(F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(F.try_parse_json(payload), path, "double"))


def loose_time(c: Column) -> Column:
    """An ISO 8601 text as a time; null if it isn't one."""
    return F.trim(c).try_cast("timestamp")


def found_at(text: Column, said: Column) -> Column:
    """``at, beside``: the places (characters from 0) at which a text that isn't empty stands in another, none over the one before.

    ``beside`` tells that a Hangul syllable stands right before or after. A text is read once, however often it has the other.
    """

    def told(texts: pa.Array, others: pa.Array) -> pa.Array:
        at, beside, upto = [], [], [0]
        for own, other in zip(texts.to_pylist(), others.to_pylist(), strict=True):
            k = own.find(other) if own and other else -1
            while k >= 0:
                end = k + len(other)
                at.append(k)
                beside.append("가" <= own[k - 1 : k] <= "힣" or "가" <= own[end : end + 1] <= "힣")
                k = own.find(other, end)
            upto.append(len(at))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(beside, pa.bool_())], ["at", "beside"]))

    return F.arrow_udf(told, "array<struct<at:int,beside:boolean>>")(text, said)


def edits(text: Column, said: Column, new: Column, nth: Column, candidate: Column) -> Column:
    """Span edits ``start, end, said`` that one asked change means: its ``nth`` place, all for null, the only one whatever the number.

    There are none where a text is empty, the change touches blanks and stops only, ``candidate`` is given but doesn't
    hold the new text, or where one of the texts has two characters or less, they are Hangul, and so is a neighbour.
    """
    bare = lambda c: F.regexp_replace(c, r"[\s.,;:!?。．，、…]+", "")
    places = found_at(text, said)
    chosen = F.when(nth.isNull() | (F.size(places) == 1), places).when(nth.between(1, F.size(places)), F.slice(places, nth, F.lit(1)))
    short = ((F.length(said) <= 2) | (F.length(new) <= 2)) & F.concat(said, new).rlike("[가-힣]")
    fine = (F.length(said) > 0) & (F.length(new) > 0) & (bare(said) != bare(new)) & (candidate.isNull() | F.contains(candidate, new))
    safe = F.when(short, F.filter(chosen, lambda s: ~s["beside"])).otherwise(chosen)
    made = F.transform(safe, lambda s: F.struct(s["at"].alias("start"), (s["at"] + F.length(said)).alias("end"), new.alias("said")))
    return F.coalesce(F.when(fine, made), F.array().cast("array<struct<start:int,end:int,said:string>>"))


def with_particle(text: Column, at: Column) -> Column:
    """The text with the particle at ``at`` (characters from 0) agreeing with the syllable before it; others stay."""
    final = final_consonant(F.substring(text, at, F.lit(1)))
    one, two = F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 1, F.lit(2))
    old = F.when(two == "으로", two).when((one == "로") | one.isin(*[x for pair in PARTICLES for x in pair]), one)
    new = F.when(old.endswith("로"), F.when(final.isin(0, 8), "로").otherwise("으로"))
    for closed, opened in PARTICLES:
        new = F.coalesce(new, F.when(old.isin(closed, opened), F.when(final > 0, closed).otherwise(opened)))
    fixed = F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, at + 1 + F.length(old), F.length(text)))
    return F.when((at > 0) & (final >= 0) & old.isNotNull(), fixed).otherwise(text)
