"""Matching blocks, reported passages and closest sentences against a full scan; Hamming classes against all pairs."""

from __future__ import annotations

import random
import re
import tracemalloc
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evidentia.functions import blocks
from evidentia.operators import hamming, joins, matching
from evidentia.plans import evidence

ALPHABETS = ["ab", "abc ", "abcdefghijklmnopqrstuvwxyz     éèü가나"]


def noise(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def altered(rng, text, times, alphabet):
    out = list(text)
    for _ in range(times):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randint(0, 3)] = noise(rng, rng.randint(0, 4), alphabet)
    return "".join(out)


def test_ratio_is_that_of_matching_blocks(monkeypatch):
    rng = random.Random(1)
    for k in range(600):
        alphabet, size = rng.choice(ALPHABETS), rng.choice([5, 30, 400])
        a = noise(rng, rng.randint(0, size), alphabet)
        b = altered(rng, a, rng.randint(0, 8), alphabet) if k % 2 else noise(rng, rng.randint(0, size), alphabet)
        monkeypatch.setattr(blocks, "MOST_POINTS", 0 if k % 5 == 0 else 1 << 23)
        assert blocks.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
        assert blocks.bound(a, b) >= blocks.ratio(a, b)
    assert blocks.ratio(None, "") == 1.0 and blocks.ratio("", "x") == 0.0


def norm(text):
    plain = re.sub(r"\s+", " ", (text or "").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^\w가-힣.%+#/-]+", " ", plain)).strip()


def split(text, most):
    out, now = [], ""
    for part in (x.strip() for x in re.split(r"\n+", text) if x.strip()):
        if now and len(now) + len(part) + 1 > most:
            out.append(now)
            now = part
        else:
            now = f"{now}\n{part}" if now else part
    return [*out, now] if now else out


def scan(needle, haystack):
    n, h = norm(needle), norm(haystack)
    if not n or not h:
        return "not_found", 0.0, ""
    if n in h:
        return "exact", 1.0, needle[:900]
    best, text = 0.0, ""
    for passage in split(haystack, max(900, min(1800, len(needle) + 500))):
        score = SequenceMatcher(None, n[:1200], norm(passage)[:1600]).ratio()
        if score > best:
            best, text = score, passage[:900]
    return "fuzzy" if best >= 0.62 else "not_found", round(best, 4), text


def pages(rng):
    for k in range(40):
        paragraphs = [noise(rng, rng.randint(0, 700), "abcdefghij klmno, pqrst-uvwxyz\t가") for _ in range(rng.randint(0, 6))]
        page = rng.choice(["\n", "\n\n"]).join(paragraphs)
        quote = rng.choice([None, "", "nowhere to be seen", page[100:400].upper(), altered(rng, page[50:350], 6, "xyz"), " " + page[:40] + " "])
        yield k, page if k % 9 else None, quote, altered(rng, page[200:260], 1, "q")
    yield 99, "same words here\n" * 200, "same wards here", "same words here same words here"


def test_verified_passages_are_those_of_a_full_scan(spark):
    rows = list(pages(random.Random(3)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, page string, quote string, sentence string, status string, place int")
    got = {r.id: r for r in matching.verified_passages(df, "id", "page", "quote", "sentence").collect()}
    assert set(got) == {r[0] for r in rows}
    for k, page, quote, sentence in rows:
        q, s = (scan((x or "").strip(" "), page or "") for x in (quote, sentence))
        best = s if s[0] == "exact" or (s[0] == "fuzzy" and s[1] >= 0.9) else q
        r = got[k]
        assert (r.match_status, r.match_score, r.matched_text, r.key_sentence_match_status, r.key_sentence_match_score, r.quote_match_status, r.quote_match_score) == (*best, s[0], s[1], q[0], q[1]), k
    assert matching.verified_passages(df.limit(0), "id", "page", "quote", "sentence").count() == 0


def scan_whole(needle, haystack):
    n, h = norm(needle), norm(haystack)
    if not n or not h:
        return "not_found", 0.0, ""
    if n in h:
        return "exact", 1.0, needle
    told = [(SequenceMatcher(None, n, norm(p)).ratio(), -k, p) for k, p in enumerate(split(haystack, max(900, len(needle) + 500)))]
    best, _, text = max(told)
    return "fuzzy" if best >= 0.62 else "not_found", round(best, 4), text if best > 0 else ""


def test_passages_and_what_is_looked_up_are_compared_whole(spark):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzéèüßñøåæœçàâêîôûäöëïÿãõ0123456789가나다라마바사아자차카타파하" + " " * 9
    long, other, tail = ("ab" + noise(rng, n, alphabet) + "yz" for n in (4000, 2600, 3000))
    many = "\n".join(noise(rng, 300, alphabet) for _ in range(30))
    rows = [
        (0, long, long, long[5:3900]),
        (1, long, altered(rng, long, 40, "xyz"), "q" * 30 + long[2500:]),
        # Alike in their first characters only, and apart in these only.
        (2, long, long[:1300] + tail, long[:1200] + noise(rng, 9000, "+-/")),
        (3, long, noise(rng, 1700, alphabet) + long[1700:], other),
        (4, other[:1700] + long + "\n" + other[:1700] + tail, other[:1650] + altered(rng, tail, 5, "q"), "nowhere"),
        (5, many, altered(rng, many[400:6400], 30, "xyz"), many[6000:9000].replace("\n", " q ")),
    ]
    df = spark.createDataFrame(rows, "id long, page string, quote string, sentence string")
    got = {r.id: r for r in matching.located(df, ["id"], ["quote", "sentence"], "page").collect()}
    for k, page, quote, sentence in rows:
        assert tuple(got[k].quote) == scan_whole(quote, page), k
        assert tuple(got[k].sentence) == scan_whole(sentence, page), k
    assert got[0].quote == ("exact", 1.0, long) and got[1].quote.matched == long
    assert (got[2].quote.status, got[2].sentence.status) == ("not_found", "not_found")
    assert got[4].quote.matched == other[:1700] + tail
    # A quote of 6,000 characters in many paragraphs is found as a whole.
    assert got[5].quote.status == "fuzzy" and len(got[5].quote.matched) > 5000


def closest(rows, signals):
    clean = lambda x: re.sub(r"[^0-9a-z가-힣]+", "", (x or "").lower())
    signals = [clean(x) for x in signals if clean(x)]
    if not signals:
        return min(k for k, _ in rows)

    def score(row):
        s = clean(row[1])
        held = max(min(len(s), len(x)) / max(1, len(s), len(x)) if s in x or x in s else 0.0 for x in signals)
        return held, max(SequenceMatcher(None, s, x).ratio() for x in signals), -row[0]

    return max(rows, key=score)[0]


def test_closest_sentences(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(60):
        sentences = [(k, noise(rng, rng.randint(0, 60), "abcde fg가.")) for k in range(rng.randint(1, 8))]
        one = rng.choice([None, "", altered(rng, rng.choice(sentences)[1], 2, "xa"), rng.choice(sentences)[1][3:20]])
        two = rng.choice([None, "", noise(rng, 20, "abcde")])
        want[key] = closest(sentences, [one, two])
        rows += [(key, k, s, one, two, 0.5) for k, s in sentences]
    df = spark.createDataFrame(rows, "claim long, place long, sentence string, one string, two string, ratio double")
    got = {r.claim: r.place for r in matching.closest_sentences(df, "claim", "place", "sentence", ["one", "two"]).collect()}
    assert got == want


def test_neighbours_cross_contexts(spark):
    turns = spark.createDataFrame([(1, 0, 'One. "Two!" three'), (1, 1, "Four?\nfive"), (2, 0, ""), (2, 1, None)], "part long, context long, text string")
    sentences = matching.numbered_sentences(turns, "part", "context", "text")
    assert [r.sentence for r in sentences.orderBy("part", "place").collect()] == ["One.", '"Two!"', "three", "Four?", "five"]
    found = spark.createDataFrame([("a", 1, 2), ("b", 1, 0)], "claim string, part long, place long")
    got = {r.claim: (r.context_ids, r.lines) for r in matching.with_neighbours(found, sentences, "claim", "part", "place", "context", "sentence").collect()}
    assert got == {"a": ([0, 1], '0: "Two!"\n0: three\n1: Four?'), "b": ([0], '0: One.\n0: "Two!"')}


def classes_by_hand(rows, within):
    key = {k: k for k, w in rows}
    change = True
    while change:
        change = False
        for a, u in rows:
            for b, v in rows:
                if key[b] < key[a] and u is not None and v is not None and sum((x ^ y).bit_count() for x, y in zip(u, v, strict=True)) <= within:
                    key[a], change = key[b], True
    return key


@pytest.mark.parametrize(("crowded", "within"), [(64, 8), (2, 8), (1, 3), (2, 0)])
def test_hamming_classes(spark, monkeypatch, crowded, within):
    monkeypatch.setattr(hamming, "CROWDED", crowded)
    rng = random.Random(within)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [[rng.getrandbits(64) for _ in range(2)] for _ in range(5)] + [[0, 0]]
    rows = [(k, None) for k in (500, 501)]
    for k in range(90):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(2)] ^= 1 << rng.randrange(64)
        rows.append((k, [signed(x) for x in own]))
    plain = [(k, None if w is None else [x & ((1 << 64) - 1) for x in w]) for k, w in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, hash array<long>, node int")
    got = hamming.classes(df, "id", "hash", within).collect()
    want = classes_by_hand(plain, within)
    assert {r.id: r.representative for r in got} == want
    assert all(r.class_size == sum(x == r.representative for x in want.values()) for r in got)
    assert hamming.classes(df.limit(0), "id", "hash", within).count() == 0


def test_difference_hash(spark):
    cells = list(range(65)) + [64]
    df = spark.createDataFrame([(cells[:65],), (None,), ([],), (cells[64::-1],)], "c array<long>")
    got = [r.h for r in df.select(hamming.difference_hash(F.col("c"), 64).alias("h")).collect()]
    assert got[0] == [-1] and got[3] == [0]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("width", [0.5, 8.0])
def test_overlapping_is_all_pairs(spark, closed, width):
    rng = random.Random(6)

    def ranges(n):
        for k in range(n):
            lo = rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-20, 20))])
            long = rng.choice([0.0, 1.0, -1.0, rng.uniform(0, 3), rng.uniform(0, 90), 2.0 ** rng.randint(-3, 6) * width])
            yield k, lo, None if lo is None or rng.random() < 0.05 else lo + long

    one, two = list(ranges(120)), list(ranges(150))
    left = spark.createDataFrame(one, "a long, lo double, hi double")
    right = spark.createDataFrame(two, "b long, start double, end double")
    got = sorted((r.a, r.b) for r in joins.overlapping(left, right, ("lo", "hi"), ("start", "end"), width, closed).collect())
    valid = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
    meets = (lambda x, y: x[1] <= y[2] and y[1] <= x[2]) if closed else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    assert got == sorted((x[0], y[0]) for x in one for y in two if valid(x) and valid(y) and meets(x, y))
    assert joins.overlapping(left.limit(0), right, ("lo", "hi"), ("start", "end"), width).count() == 0


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 20, 1 << 21), (900, 1 << 20, 1 << 21), (1 << 18, 3000, 1 << 21), (1 << 18, 1 << 20, 200)])
def test_ratios_of_many_pairs_are_those_of_each(monkeypatch, limits):
    for name, limit in zip(("MOST_CHARACTERS", "MOST_TOGETHER", "MOST_CELLS"), limits, strict=True):
        monkeypatch.setattr(blocks, name, limit)
    rng = random.Random(2)
    pairs = [(None, ""), ("", "x"), ("\0\0a", "a\0"), ("ab" * 300, "ab" * 300)]
    for k in range(300):
        alphabet, size = rng.choice(ALPHABETS), rng.choice([5, 30, 400])
        a = noise(rng, rng.randint(0, size), alphabet)
        pairs.append((a, altered(rng, a, rng.randint(0, 8), alphabet) if k % 2 else noise(rng, rng.randint(0, size), alphabet)))
    ones, twos = [a for a, _ in pairs], [b for _, b in pairs]
    assert blocks.ratios(ones, twos).tolist() == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]
    assert blocks.bounds(ones, twos).tolist() == [blocks.bound(a, b) for a, b in pairs]
    many = [[rng.choice(twos) or "" for _ in range(rng.randint(0, 4))] for _ in ones]
    place, score = blocks.best_of(ones, [*many[:-1], None])
    for a, own, k, r in zip(ones, [*many[:-1], None], place, score, strict=True):
        told = [] if a is None or own is None else [SequenceMatcher(None, a, b).ratio() for b in own]
        assert (k, r) == ((told.index(max(told)), max(told)) if told else (-1, -1.0))
    assert len(blocks.ratios([], [])) == 0


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_ratio_of_long_texts_is_that_of_matching_blocks(monkeypatch, most):
    monkeypatch.setattr(blocks, "MOST_POINTS", most)
    monkeypatch.setattr(blocks, "LONG", 700)
    rng = random.Random(most)
    wide = ["abcdefghijklmnopqrstuvwxyz" * 3 + "0123456789가나다라마바사아자" + " " * 20, "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    pairs = []
    for k in range(150):
        alphabet, size = rng.choice([*ALPHABETS, *wide]), rng.choice([30, 400, 1500])
        a = noise(rng, rng.randint(0, size), alphabet) * rng.choice([1, 1, 3])
        pairs.append((a, altered(rng, a, rng.randint(0, 30), alphabet) if k % 3 else noise(rng, rng.randint(0, size), alphabet) * 2))
    assert blocks.ratios(*map(list, zip(*pairs, strict=True))).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_points_of_long_texts_are_not_held():
    # Of these texts 5 million pairs of characters are equal and may begin a block.
    rng = random.Random(4)
    text = noise(rng, 60_000, "".join(map(chr, range(0x4E00, 0x4E00 + 700))))
    short = "".join(c for c in text if rng.random() > 0.002)
    tracemalloc.start()
    got = blocks.ratio(short, text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 2 * len(short) / (len(short) + len(text)) and most < 100e6


def test_verified_passages_shuffle_nothing(spark):
    page, quote, sentence = "A page.\nIts end, Σ.\n\n \nx", "a PAGE. its", "its endx"
    df = spark.createDataFrame([(1, page, quote, sentence)], "id long, page string, quote string, sentence string")
    got = matching.verified_passages(df, "id", "page", "quote", "sentence")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1
    (q, r), (s, t) = scan(quote, page)[:2], scan(sentence, page)[:2]
    assert got.first()[1:] == (q, r, quote, s, t, q, r) and (q, s) == ("exact", "not_found")


def test_closest_sentence_by_another_signal_than_the_one_with_the_largest_bound(spark):
    rows = [(1, k, s, "abcdefgh", "xyz11111") for k, s in enumerate(["22xy222", "hgfedcbaxyz", "33"])]
    df = spark.createDataFrame(rows, "claim long, place long, sentence string, one string, two string")
    assert [tuple(r) for r in matching.closest_sentences(df, "claim", "place", "sentence", ["one", "two"]).collect()] == [(1, 1)]
    own = spark.createDataFrame([(1, [r[2] for r in rows], *rows[0][3:])], "claim long, said array<string>, one string, two string")
    assert matching.closest_own(own, "said", ["one", "two"]).first().place == 1


def test_closest_of_own_sentences(spark):
    rng = random.Random(9)
    rows, want = [(-1, [], "a", "b")], {-1: None}
    for key in range(150):
        sentences = [noise(rng, rng.randint(0, 60), "abcde fg가.") for _ in range(rng.randint(1, 8))]
        one = rng.choice([None, "", altered(rng, rng.choice(sentences), 2, "xa"), rng.choice(sentences)[3:20]])
        two = rng.choice([None, "", noise(rng, 20, "abcde")])
        want[key] = closest(list(enumerate(sentences)), [one, two])
        rows.append((key, sentences, one, two))
    df = spark.createDataFrame(rows, "claim long, said array<string>, one string, two string")
    own = matching.closest_own(df, "said", ["one", "two"])
    assert {r.claim: r.place for r in own.collect()} == want
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_sentences_are_those_of_the_plain_rule(spark):
    rng = random.Random(10)
    rule = r"""(?s).+?(?:[.!?。！？]+["'”’)\]]*(?=[\s\x1c-\x1f\x85\xa0]|\Z)|\n+|\Z)"""
    texts = [noise(rng, rng.randint(0, 30), "ab.!?。！\n\n \"')”]\t\x1f가") for _ in range(3000)] + ["." * 50_000 + "a", "a" * 50_000, "a. " * 9_000]
    cut = [[y for x in re.findall(rule, t.strip(" \t\n\x0b\f\r")) if (y := x.strip(" \t\n\x0b\f\r"))] for t in texts[:3000]] + [texts[3000:3001], texts[3001:3002], ["a."] * 9_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.s for r in df.select("k", matching.transcript_sentences(F.col("t")).alias("s")).collect()}
    assert got == dict(enumerate(cut))


def test_claims_cut_turns_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(evidence, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    evidence.claim_sentences(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and plans[0].count("regexp_extract_all(") == 1 and "Join" not in plans[0]


def test_claims_of_turns_without_text(spark, tmp_path):
    turns = [(1, 0, "user", "One two. Three four! Five."), (1, 1, "user", ""), (1, 2, "user", None), (1, 3, "user", " \n "), (1, 4, "user", "six")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.claim: (r.place, r.contexts, r.lines) for r in evidence.claim_sentences(spark, str(tmp_path)).collect()}
    assert got == {"1:0": (1, "0", "0: One two.\n0: Three four!\n0: Five."), "1:4": (3, "0,4", "0: Five.\n4: six")}
