"""The best match of a text among many: bounds first, the ratio itself only where it can still win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import blocks, text
from evidentia.operators.evidence import usable_passage
from evidentia.sources.session import stored

#: A page's passages have so many characters, or as many as the needle and so many more.
SHORTEST, MORE = 900, 500
#: The least ratio of a match that isn't exact.
FUZZY = 0.62


def match_text(c: Column) -> Column:
    """A text in lower case with single spaces for all but letters, digits and ``_.%+#/-``."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_.%+#/-]+", " "))


def sentence_text(c: Column) -> Column:
    """A text's letters a-z, digits and Hangul syllables in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]+", "")


def transcript_sentences(c: Column) -> Column:
    """The sentences of a text: up to a terminator and closing marks before white space, a line's end, or the end."""
    # Runs with and without terminators are taken whole: a sentence ends at all places of a run of them or at none, and
    # asking at each one takes time with the square of the run.
    ends, rest = "[.!?。！？]", r"[^.!?。！？\n]*+"
    end = rf"""{ends}++["'”’)\]]*+(?=[\s\x1c-\x1f\x85\p{{Z}}]|\z)"""
    found = F.regexp_extract_all(text.strip(F.coalesce(c, F.lit(""))), F.lit(rf"(?s).{rest}(?:(?!{end}){ends}++{rest})*+(?:{end}|\n+|\z)"), F.lit(0))
    return F.filter(F.transform(found, text.strip), lambda x: x != "")


def best_by_ratio(pairs: DataFrame, keys: list[str], place: str, one: str, two: str) -> DataFrame:
    """``keys``, ``place``, ``ratio`` and the other columns of the row of each key whose texts match best, the first by place.

    A row's bound is told from its characters alone. The row with the largest bound of each key is compared first;
    of the others only those whose bound still beats its ratio are compared at all. Rows of a key are never put
    together in one task: both steps are grouped maxima and an equi-join on the keys.
    """
    rest = [c for c in pairs.columns if c not in (*keys, place)]
    rows = stored(pairs.withColumn("_bound", blocks.ratio_bound(F.col(one), F.col(two))))
    head = F.max(F.struct("_bound", (-F.col(place)).alias("_back"), F.struct(place, *rest).alias("_row"))).alias("_top")
    first = rows.groupBy(*keys).agg(head).select(*keys, "_top._row.*")
    first = stored(first.withColumn("ratio", blocks.matching_ratio(F.col(one), F.col(two))))
    known = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ratio").alias("_ratio"), F.col(place).alias("_place"), F.col(one).alias("_one"), F.col(two).alias("_two"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    still = (F.col("_bound") > F.col("_ratio")) | ((F.col("_bound") == F.col("_ratio")) & (F.col(place) < F.col("_place")))
    # A place may have several rows; only the one that was compared is left out.
    done = (F.col(place) == F.col("_place")) & F.col(one).eqNullSafe(F.col("_one")) & F.col(two).eqNullSafe(F.col("_two"))
    later = rows.join(known, same & still).filter(~done).select(*keys, place, *rest)
    later = later.withColumn("ratio", blocks.matching_ratio(F.col(one), F.col(two)))
    best = F.max(F.struct("ratio", (-F.col(place)).alias("_back"), F.struct(place, *rest).alias("_row"))).alias("_top")
    return first.unionByName(later.select(*first.columns)).groupBy(*keys).agg(best).select(*keys, "_top.ratio", "_top._row.*")


def located(rows: DataFrame, keys: list[str], needles: list[str], haystack: str) -> DataFrame:
    """``keys``, and for each of ``needles`` ``status, score, matched`` under its name: where it stands in its row's haystack.

    ``exact`` if the haystack has it as it is, but for case, marks and spaces; else the passage that matches best, as
    ``fuzzy`` from ``FUZZY`` on, below that as ``not_found``. Of passages that match alike the first is taken. An empty
    or null text is not found. Needles and passages are compared whole and given back whole; passages grow with their
    needle, so that a long one finds its like. A row is told by itself: nothing is shuffled, and a haystack is made
    plain once, a paragraph at a time, since passages end where a paragraph does.
    """
    own = rows.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in needles], text.paragraphs(F.coalesce(haystack, F.lit(""))).alias("_parts"))
    own = own.withColumns({"_plain": F.transform("_parts", match_text), **{f"_n_{c}": match_text(F.col(c)) for c in needles}})
    own = own.withColumn("_h", F.array_join(F.filter("_plain", lambda x: x != ""), " "))
    own = own.withColumns({f"_exact_{c}": (F.col(f"_n_{c}") != "") & F.contains("_h", f"_n_{c}") for c in needles})
    open_ = {c: (F.col(f"_n_{c}") != "") & (F.col("_h") != "") & ~F.col(f"_exact_{c}") for c in needles}
    most = {c: F.greatest(F.lit(SHORTEST), F.length(c) + MORE) for c in needles}
    own = own.withColumns({f"_at_{c}": F.when(open_[c], text.passage_ranges(F.col("_parts"), most[c])) for c in needles})
    piece = lambda x: F.array_join(F.filter(F.slice("_plain", x["first"], x["last"] - x["first"] + 1), lambda y: y != ""), " ")
    best = {f"_best_{c}": blocks.best_match(F.col(f"_n_{c}"), F.transform(f"_at_{c}", piece)) for c in needles}
    own = own.withColumns(best)

    def found(c: str) -> Column:
        ratio, at = F.col(f"_best_{c}.ratio"), F.get(f"_at_{c}", F.col(f"_best_{c}.place"))
        passage = F.array_join(F.slice("_parts", at["first"], at["last"] - at["first"] + 1), "\n")
        told = lambda status, score, matched: F.struct(F.lit(status).alias("status"), score.alias("score"), matched.alias("matched"))
        out = F.when(F.col(f"_exact_{c}"), told("exact", F.lit(1.0), F.col(c)))
        out = out.when(ratio >= FUZZY, told("fuzzy", F.round(ratio, 4), passage)).when(ratio > 0, told("not_found", F.round(ratio, 4), passage))
        return out.otherwise(told("not_found", F.lit(0.0), F.lit("")))

    return own.select(*keys, *[found(c).alias(c) for c in needles])


def verified_passages(rows: DataFrame, key: str, page: str, quote: str, sentence: str) -> DataFrame:
    """Whether what a model reported of a page stands there: its key sentence where that match is usable, else its quote.

    ``key, match_status, match_score, matched_text``, and status and score of both. Null and empty texts aren't found;
    an empty table gives no rows.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    each = rows.select(F.col(key), F.col(page).alias("_page"), said(quote).alias("quote"), said(sentence).alias("sentence"))
    both = located(each, [key], ["quote", "sentence"], "_page")
    chosen = F.when(usable_passage(F.col("sentence.status"), F.col("sentence.score")), F.col("sentence")).otherwise(F.col("quote"))
    both = both.withColumn("chosen", chosen)
    return both.select(
        key,
        F.col("chosen.status").alias("match_status"),
        F.col("chosen.score").alias("match_score"),
        F.col("chosen.matched").alias("matched_text"),
        F.col("sentence.status").alias("key_sentence_match_status"),
        F.col("sentence.score").alias("key_sentence_match_score"),
        F.col("quote.status").alias("quote_match_status"),
        F.col("quote.score").alias("quote_match_score"),
    )


def closest_sentences(candidates: DataFrame, key: str, place: str, sentence: str, signals: list[str]) -> DataFrame:
    """``key, place``: each claim's closest sentence among its candidates.

    A sentence that holds a signal, or stands in one, comes before all that don't, the more alike in length the
    sooner; then the ratio counts, then the lowest place. A claim without a signal has its first candidate.
    """
    own = candidates.select(key, place, sentence_text(F.col(sentence)).alias("s"), F.filter(F.array(*[sentence_text(F.col(c)) for c in signals]), lambda x: x != "").alias("signals"))

    def held(signal: Column) -> Column:
        a, b = F.length("s"), F.length(signal)
        within = F.contains(signal, F.col("s")) | F.contains(F.col("s"), signal)
        return F.when(within, F.least(a, b) / F.greatest(F.lit(1), a, b)).otherwise(0.0)

    own = own.withColumn("held", F.coalesce(F.array_max(F.transform("signals", held)), F.lit(0.0)))
    # Only the candidates that are held best can win; of these the ratio decides.
    most = own.groupBy(key).agg(F.max("held").alias("most"))
    own = own.join(most, key).filter("held = most").select(key, place, "s", F.explode_outer("signals").alias("signal"))
    none = own.filter("signal is null").groupBy(key).agg(F.min(place).alias(place))
    return best_by_ratio(own.filter("signal is not null"), [key], place, "s", "signal").select(key, place).unionByName(none)


def closest_own(claims: DataFrame, sentences: str, signals: list[str]) -> DataFrame:
    """``claims`` with ``place``: which of its own array of sentences is each claim's closest, by the rule of :func:`closest_sentences`.

    Places count from 0; without sentences it is null. A row is told by itself, and only sentences that are held alike
    are compared by their ratio.
    """
    names = [f"_signal{k}" for k in range(len(signals))]
    own = claims.withColumns({n: F.nullif(sentence_text(F.col(c)), F.lit("")) for n, c in zip(names, signals, strict=True)} | {"_plain": F.transform(sentences, sentence_text)})

    def held(s: Column, signal: str) -> Column:
        a, b = F.length(s), F.length(signal)
        within = F.contains(F.col(signal), s) | F.contains(s, F.col(signal))
        return F.when(within, F.least(a, b) / F.greatest(F.lit(1), a, b)).otherwise(0.0)

    own = own.withColumn("_held", F.transform("_plain", lambda s: F.greatest(F.lit(0.0), *[held(s, n) for n in names])))
    own = own.withColumn("_most", F.array_max("_held"))
    each = F.transform("_plain", lambda s, i: F.struct(i.alias("at"), s.alias("s"), F.get("_held", i).alias("held")))
    own = own.withColumn("_best", F.filter(each, lambda x: x["held"] == F.col("_most")))
    left = F.when(F.size("_best") > 1, F.transform("_best", lambda x: x["s"]))
    own = own.withColumns({f"_told{n}": blocks.best_match(F.col(n), left, turned=True) for n in names})
    # The best ratio with any signal, the lowest place; without ratios the first of those held best.
    top = F.array_max(F.array(*[F.struct(F.col(f"_told{n}.ratio").alias("ratio"), (-F.col(f"_told{n}.place")).alias("back")) for n in names]))
    place = F.get("_best", F.when(top["ratio"] >= 0, -top["back"]).otherwise(0))["at"]
    return own.select(*claims.columns, place.cast("long").alias("place"))


def with_neighbours(found: DataFrame, sentences: DataFrame, key: str, part: str, place: str, context: str, sentence: str) -> DataFrame:
    """``key, context_ids, lines``: each closest sentence with the one before and after it, each after its context's id.

    ``sentences`` are numbered by ``place`` within their ``part`` (a recording).
    """
    near = found.select(key, part, F.explode(F.array(F.col(place) - 1, F.col(place), F.col(place) + 1)).alias(place))
    rows = near.join(sentences.select(part, place, context, sentence), [part, place]).filter(F.trim(sentence) != "")
    # Three rows a key at most.
    taken = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, context, sentence))).alias("taken"))
    line = lambda x: F.concat(x[context].cast("string"), F.lit(": "), x[sentence])
    return taken.select(key, F.array_distinct(F.transform("taken", lambda x: x[context])).alias("context_ids"), F.array_join(F.transform("taken", line), "\n").alias("lines"))


def numbered_sentences(rows: DataFrame, part: str, context: str, said: str) -> DataFrame:
    """``part, context, place, sentence``: the sentences of a recording's contexts in order, numbered from 0."""
    return numbered(rows.select(part, context, transcript_sentences(F.col(said)).alias("_said")), part, context, "_said").drop("own")


def numbered(rows: DataFrame, part: str, context: str, said: str, *kept: str) -> DataFrame:
    """:func:`numbered_sentences` of contexts that are arrays of sentences already, with each one's ``own`` place there and what is kept."""
    # An outer one, since from the other kind Spark infers a filter and cuts the sentences for that once more.
    each = rows.select(part, context, *kept, F.posexplode_outer(said).alias("own", "sentence")).filter("own is not null")
    return each.withColumn("place", (F.row_number().over(Window.partitionBy(part).orderBy(context, "own")) - 1).cast("long")).select(part, context, "place", "sentence", "own", *kept)
