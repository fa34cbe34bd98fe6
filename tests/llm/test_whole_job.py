"""Cases where an operator once did less than the whole job."""

from __future__ import annotations

from evidentia.llm import decontamination, jaccard, licenses, pii

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
OTHER = "lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_spans_stay_within_their_document(spark):
    rows = [(1, 1, PASSAGE), (2, 2, OTHER), (3, 3, ""), (4, 4, f"own {PASSAGE}"), (5, 5, f"{OTHER} {PASSAGE} own")]
    docs = spark.createDataFrame(rows, "row_key long, doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", PASSAGE), ("b", OTHER)], "item_id string, text string")
    got = {r.doc_id: ([(s.lo, s.hi) for s in r.spans], r["items"]) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {1: ([(0, 10)], ["a"]), 2: ([(0, 10)], ["b"]), 3: ([], []), 4: ([(1, 11)], ["a"]), 5: ([(0, 20)], ["a", "b"])}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert cut == {1: "", 2: "", 3: "", 4: "own ", 5: " own"}


def test_account_numbers_end_where_their_country_says():
    def ibans(text: str) -> list[str]:
        return [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"]

    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    for own in (de, gb, no):
        for tail in ("", " BIC COBADEFF", " EUR 20", " 2026 AND MORE WORDS IN CAPITALS", " ok", ".", "é"):
            assert ibans(f"IBAN {own}{tail}") == [own]
            assert ibans(f"IBAN {own.replace(' ', '')}{tail}") == [own.replace(" ", "")]
    assert ibans(f"REF AB12 NUMBER {de} {gb} BIC WESTGB2L") == [de, gb]
    assert ibans(f"{de}X {de}9 IBAN DE88 3704 0044 0532 0130 00 BIC") == []
    assert ibans("IBAN ZZ22 3704 0044 0532 0130 00 EUR") == ["ZZ22 3704 0044 0532 0130 00"]


def test_one_of_each_text_whatever_its_id(spark):
    base = " ".join(f"t{k}" for k in range(200))
    rows = [(None, base), (None, base.replace("t50 ", "zz ")), (None, "these words stand alone here"), (None, "and so do all of these"), (None, "and so do all of these"), (None, "")]
    rows += [(7, "one text of a repeated id"), (7, "quite another of the same one"), (7, "copied words of two ids here"), (9, "copied words of two ids here"), (3, "linked with a null id now"), (None, "linked with a null id now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs, jaccard.Similarity()).collect()]
    whole = [x for x in got if x[1] and x[1].startswith("t0 ")]
    assert len(whole) == 1 and whole[0] in rows[:2]
    want = {rows[2], rows[3], rows[5], rows[6], rows[7], rows[8], rows[10]}
    assert len(got) == 8 and set(got) == want | set(whole)


def test_each_license_rule_alone_in_a_text(spark):
    said = ["Distributed under the GNU GPL v 3", "released under the terms of the MPL 2.0", "Apache 2.0", "LGPL version 2.1", "PROVIDED UNDER ISC", "cc-by-sa/4.0", "no terms here", "commit, accept"]
    want = ["gpl-3", "mpl-2", "apache-2", "lgpl-2.1", "isc", "cc-by-sa-4", "", ""]
    own = licenses.rules()
    samples = []
    for r in own:
        text = r.pattern
        for some, one in ((f"(?:{licenses._GRANT})", "released"), ("(?: license | licence )?", ""), ("(?: license | licence )", " license "), ("(?: version | v )?", ""), ("(?: terms  of  the )?", ""), ("(?: the )?", ""), ("(?: license )?", ""), ("(?: 1  0 )?", "")):
            text = text.replace(some, one)
        samples.append(text.replace("(?:dedicated|released|placed)", "placed").replace("(?:to|into|in)", "in") + (r.keyword if r.label == "unknown" else ""))
    assert not [x for x in samples if "(" in x]
    docs = spark.createDataFrame([(k, " ".join(x.split())) for k, x in enumerate([*said, *samples])], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.labelled(docs).collect()}
    assert [got[k][0] for k in range(len(said))] == want
    assert not [(r, got[len(said) + k]) for k, r in enumerate(own) if got[len(said) + k][1] < licenses.CONFIDENCE[r.tier]]
