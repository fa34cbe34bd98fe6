"""Conversation repair, filter audit and packing against brute force, on random and on hard rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import audit, packing, repair
from evidentia.llm.oracles import ORACLES
from tests.checks import connection, same

ROLES = ["system", "user", "assistant", "tool", "", None]
SAYS = ["Yes.", "no", "What?", "", " \t", None, "so. It", "Aha! "]


def turns(spark, rows):
    return spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string, n long, code int, part string")


def talk(seed, conversations=60, most=9):
    rng, out = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for k in range(rng.randint(1, most)):
            turn = rng.choice([None, k, k, k, k, k + 2])
            out.append((conv, turn, rng.choice(ROLES[:3] * 4 + ROLES), rng.choice(SAYS), 5, 6, "x"))
    return out


def by_hand(rows):
    """Each conversation's result by plain costs and whole strings, forward only."""
    convs: dict = {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, blank, duplicate, truncated, states = set(), 0, 0, 0, {"": (0, "", ())}

        def put(to, state, cost, letter, row, old):
            new = (old[0] + cost, old[1] + letter, old[2] + row)
            if state not in to or new < to[state]:
                to[state] = new

        def grown(states):
            for _ in range(3):
                for q, v in list(states.items()):
                    put(states, "u" if q != "u" else "a", 2, "I", ("user:" if q != "u" else "assistant:",), v)
            return states

        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
            to: dict = {}
            for q, v in grown(states).items():
                put(to, q, 3, "D", (), v)
                if fault in ("", "truncated"):
                    more, goal = int(fault == "truncated"), "u" if q != "u" else "a"
                    put(to, goal, 2 + more, "R", (f"{'user' if goal == 'u' else 'assistant'}:{text}",), v)
                    if role[:1] == goal or (q == "" and role[:1] == "s"):
                        put(to, role[:1], more, "K", (f"{role}:{text}",), v)
            states = to
        cost, letters, said = min(v for q, v in grown(states).items() if q in ("", "a"))
        told = [x[0] for x in own if x[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        out[conv] = (gaps, blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [1, 2, 5, repair.PIECE])
def test_repair_by_hand(spark, most):
    rows = talk(most)
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(turns(spark, rows), most).collect()}
    assert got == by_hand(rows)


def test_repair_of_one_long_conversation_in_many_pieces(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(ROLES[:3]), f"{rng.randint(0, 150)} {rng.choice(['.', ''])}", 0, 0, "") for k in range(900)]
    rows += [(1, 17, "user", "again.", 0, 0, "")] * 40
    got = repair.repaired(turns(spark, rows), 16).collect()
    assert [tuple(r)[1:] for r in got] == list(by_hand(rows).values())


def test_repair_edges(spark):
    assert repair.repaired(turns(spark, [])).count() == 0
    gone = next(k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.repaired(turns(spark, [(gone, 0, "user", "Hi.", 0, 0, "")])).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    kept = next(k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    got = repair.repaired(turns(spark, [(kept, 0, "user", "x " * 200_000 + ".", 0, 0, "")])).first()
    assert (got.cost, got.audit, got.truncated) == (2, "KI", 0)


DOCS = "doc_id long, text string, lang string, source string, n long, mask int, digest string, part int, at long, row_key long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, 2, "x", 3, 4, 5) for d, t, s in rows], DOCS)


def filters(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))


def audit_by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {s or "" for _, _, s in rows}:
            left = [(d, "".join(x for x, f in zip("ABCDE", (*filters(t or ""), d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in rows)), strict=True) if f)) for d, t, s in rows if (s or "") == part]
            every = list(left)
            for step, x in enumerate(order, 1):
                away = [d for d, f in left if x in f]
                before = [f for _, f in every if x in f]
                left = [(d, f) for d, f in left if x not in f]
                out[part, order, step] = [len(left), len(away), len(before) - len(away), sum(f == x for f in before), sum(d in good for d in away), sum(d in toxic for d in away)]
    for (part, order, step), v in out.items():
        v.append(sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_hand(spark):
    rng, long = random.Random(3), " ".join(f"w{k}" for k in range(60))
    texts = [None, "", long, long + " # A", "a b", "AB " * 60, long.upper(), " ".join("a b".split() * 40), long + "é" * 50_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s0", "s0", "s1"])) for _ in range(90)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(30)] + [(3, 1, 0), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(documents(spark, rows), frame).collect()
    by = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(by) and by == audit_by_hand(rows, labels)
    assert audit.audit(documents(spark, []), frame).count() == 0


def test_audit_sql_on_hard_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "", ""), (2, "", "a"), (3, "# x", "a"), (4, "# x", "b"), (4, "# x", "b"), (0, "X " * 70, "b")]
    docs, labels = documents(spark, rows), spark.createDataFrame([(4, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    same(audit.audit(docs, labels).toPandas(), connection(str(tmp_path)).execute(ORACLES["op12_audit"]).df())


def packed_by_hand(rows, own, sequence, grain):
    """The stream of a deficit round-robin that is played round by round; ``rows`` are (key, source, ids) in order."""
    queues: dict = {}
    for key, source, ids in rows:
        queues.setdefault(source, []).extend((key, at, min(len(ids), at + grain)) for at in range(0, len(ids), grain))
    total = sum(len(ids) for *_, ids in rows)
    weight = {s: sum(len(i) for _, t, i in rows if t == s) / total for s in queues} | own
    credit = {s: max(1, int(np.ceil(weight[s] * sequence * 65536))) for s in queues}
    deficit, out = dict.fromkeys(queues, 0), []
    while any(queues.values()):
        for s in sorted(queues):
            deficit[s] += credit[s]
            while queues[s] and (queues[s][0][2] - queues[s][0][1]) * 65536 <= deficit[s]:
                key, lo, hi = queues[s].pop(0)
                deficit[s] -= (hi - lo) * 65536
                out.append((key, lo, hi))
    return out


TEXTS = [None, "", "one", "It's the 3rd É test’s — 日本語 #", "w " * 500, "café, naïve!! don't... x\x0by z ́a ǅ İ ﬁ", "<|endoftext|> a", "z\x00" * 9, " ".join(f"wörd{k}" for k in range(700)), "ça va" * 40]


@pytest.mark.parametrize(("sequence", "grain", "weights"), [(64, 8, {}), (128, 32, {"a": 0.2, "b": 0.7, "": 0.1}), (4096, 32, {}), (16, 1, {"a": 1.0})])
def test_packing_plays_the_rounds(spark, sequence, grain, weights):
    rng = random.Random(sequence)
    rows = [(k % 37 if k % 5 else None, rng.choice(TEXTS), rng.choice([None, "", "a", "a", "b"])) for k in range(60)]
    docs = documents(spark, rows).coalesce(1)
    own = packing.Packing(sequence=sequence, grain=grain, weights=weights)
    whole = Tokenizer.from_file(own.tokenizer)
    whole.encode_special_tokens = True
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, _ in rows]
    named = {s: w / sum(weights.values()) for s, w in weights.items()}
    stream = packed_by_hand([(k, s or "", ids[k]) for k, (_, _, s) in enumerate(rows)], named, sequence, grain)
    got = packing.pack(docs, own).orderBy("sequence_id", "offset").collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    want, whole_tokens, rest = [], sum(map(len, ids)) // sequence * sequence, sum(map(len, ids)) % sequence
    edges = [*range(0, whole_tokens + 1, sequence)]
    for k in reversed(range(sequence.bit_length())):
        if rest >> k & 1:
            edges.append(edges[-1] + (1 << k))
    at = 0
    for key, lo, hi in stream:
        while lo < hi:
            n = int(np.searchsorted(edges, at, side="right")) - 1
            take = min(hi - lo, edges[n + 1] - at)
            if want and want[-1][0] == key and want[-1][3] == n and want[-1][1] + want[-1][2] == lo:
                want[-1][2] += take
            else:
                want.append([key, lo, take, n, at - edges[n]])
            lo, at = lo + take, at + take
    told = [(rows[k][0], lo, n, zlib.crc32(ids[k][lo : lo + n].tobytes()), len(ids[k]), seq, off, rows[k][2] or "") for k, lo, n, seq, off in want]
    assert [tuple(r) for r in got] == told


def test_packing_edges(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    one = packing.pack(documents(spark, [(7, None, None)])).collect()
    assert [tuple(r) for r in one] == [(7, 0, 1, zlib.crc32(b"\x02\0\0\0"), 1, 0, 0, "")]


def test_packing_keeps_the_mixture(spark):
    rows = [(k, " ".join(f"t{(k * 31 + i) % 997}" for i in range(40 + k % 300)), "hot" if k % 3 else f"s{k % 12}") for k in range(900)]
    out = packing.pack(documents(spark, rows), packing.Packing(sequence=1024, grain=16))
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n & (r.n - 1) == 0 for r in full)
    hot = [r.n for r in out.filter("source = 'hot'").groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()][: len(full) - 12]
    assert max(hot) - min(hot) < 0.2 * 1024


@pytest.mark.parametrize("size", [1, 5, 9000])
def test_before_sums_up_all_levels(spark, size):
    rows = spark.range(0, size * 7, 7).select(F.col("id").alias("place"), (F.col("id") % 13).alias("v"))
    got = {r.place: r.before for r in packing.before(rows, "place", "v").collect()}
    sums = list(itertools.accumulate([0, *((7 * k) % 13 for k in range(size - 1))]))
    assert got == {7 * k: s for k, s in enumerate(sums)}


def test_contained_hits_go(spark):
    from evidentia.llm import licenses

    rng, rows = random.Random(1), []
    for k in range(200):
        spans = [(rng.randint(0, 8), 1, "x", lo := rng.randint(0, 30), lo + rng.randint(1, 9)) for _ in range(rng.randint(0, 40))]
        rows.append((k, list(dict.fromkeys(spans))))
    df = spark.createDataFrame([*rows, (999, None)], "k int, hits array<struct<nr:int,tier:int,label:string,lo:int,hi:int>>")
    got = {r.k: r.left for r in df.select("k", licenses._uncontained(F.col("hits")).alias("left")).collect()}
    assert got.pop(999) is None
    for k, hits in rows:
        assert sorted(map(tuple, got[k])) == sorted(a for a in hits if not any(b[3] <= a[3] and b[4] >= a[4] and b[0] < a[0] for b in hits))
