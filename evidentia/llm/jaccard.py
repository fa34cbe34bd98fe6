"""N-gram Jaccard join with PartEnum signatures, and its connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words
from evidentia.llm.keys import free_name, in_small_batches, maybe_broadcast, maybe_in, smallest_first
from evidentia.operators.graph import connected_components
from evidentia.sources.session import checkpointed, stored

#: Ratio of the largest to the smallest set size of a band.
BAND_RATIO = 1.5
#: Elements that two sets may differ in within a partition, and the second-level partitions it is cut into.
INNER, CUTS = 1, 2
#: Partitions beyond those that the distance bound needs, as a share of them.
SPARE = 0.3
#: Further partitionings for sets that leave too many partitions of the others empty.
FAMILIES = 4
#: A bucket of more sets is hot. Pairs in it only matter between sets that may have no other bucket in common;
#: these are joined by their rarest elements.
HOT = 8
#: Bits of a set's sketch.
SKETCH_BITS = 1024
#: Set ids that a task remembers, so that it signs copies once.
_REMEMBERED = 1 << 20
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F
#: Odd factors that tell the places in a subset apart.
_TURNS = words.mix(np.arange(CUTS - INNER, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Sets of ``width``-word shingles link when ``100 * intersection >= percent * union``."""

    width: int = 5
    percent: int = 80

    def linked(self, a: int, b: int, both: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def least_common(self, size: Column, other: Column) -> Column:
        """The fewest elements that two linked sets of these sizes have in common."""
        return F.ceil(F.lit(self.percent) * (size + other) / (100 + self.percent))

    def distance(self, size: int) -> int:
        """The most elements that two linked sets of at most ``size`` elements differ in."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)


def band_tops() -> np.ndarray:
    """The largest set size of each band."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return np.array(tops, np.int64)


_TOPS = band_tops()


def shingle_sets(part: words.Slice, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Document number and sorted distinct shingle hashes; a text of fewer words is one shingle, none is empty."""
    every = words.runs(part.hashes, width, _SHINGLE_BASE)
    for i in range(part.hi - part.lo):
        lo, hi = part.first[i], part.first[i + 1]
        if hi - lo >= width:
            yield part.lo + i, np.unique(every[lo : hi - width + 1])
        elif hi > lo:
            yield part.lo + i, words.mix(words.runs(part.hashes[lo:hi], int(hi - lo), _SHINGLE_BASE) + np.uint64(hi - lo))
        else:
            yield part.lo + i, np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit id of a set: equal sets have equal ids."""
    with np.errstate(over="ignore"):
        total = words.mix(shingles).sum(dtype=np.uint64)
        return int(words.mix(np.array([total ^ (np.uint64(len(shingles)) * np.uint64(0x9E3779B97F4A7C15))]))[0].astype(np.int64))


#: The subsets of second-level partitions that are enumerated: all but ``INNER`` of them.
SUBSETS = list(combinations(range(CUTS), CUTS - INNER))


@lru_cache(maxsize=64)
def _places(n: int, parting: int) -> np.ndarray:
    """A hash of each subset's place in one partitioning."""
    return words.mix(np.arange(n * len(SUBSETS), dtype=np.uint64).reshape(n, len(SUBSETS)) + (np.uint64(parting) << np.uint64(40)))


def signatures(shingles: np.ndarray, like: Similarity) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """PartEnum signatures of a set as ``(hashes, partitions, band, slack)``.

    Two linked sets lie in one band of sizes, or the smaller one is near the next band and signs for it too. In a
    band whose largest size allows a distance of k, the shingle domain is cut in k div 2 + 1 + m partitions. Linked
    sets differ in two elements or more in at most k div 2 of them, so in m + 1 partitions at least they differ in
    one element or none. Each partition is cut into ``CUTS``, and each subset of all but one of these gives a
    signature: one element stands in one of the cuts only, so the sets agree on the subset without it. A subset without
    elements gives no signature. ``slack`` is m less the partitions in which the set has such a subset: a set with slack 0 or
    more shares a signature with every partner. A set with less signs under another partitioning too; only two such
    sets can need it, and both have it.
    """
    out = []
    size = len(shingles)
    band = int(np.searchsorted(_TOPS, size))
    reach = like.largest_partner(size)
    mixed = words.mix(shingles)
    while band == 0 or _TOPS[band - 1] + 1 <= max(reach, size):
        k = like.distance(int(_TOPS[band]))
        if k:
            need = k // (INNER + 1) + 1
            spare = 1 + int(need * SPARE)
            n = need + spare
            for family in range(FAMILIES):
                own = shingles if family == 0 else np.sort(words.mix(shingles + np.uint64(family)))
                part = ((own >> np.uint64(32)) * np.uint64(n * CUTS)) >> np.uint64(32)
                heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                sums = np.zeros(n * CUTS, np.uint64)
                sums[part[heads].astype(np.int64)] = words.mix(np.add.reduceat(mixed if family == 0 else words.mix(own), heads))
                sums = sums.reshape(n, CUTS)
                turned = sums[:, :, None] * _TURNS
                told = np.stack([sum(turned[:, c, at] for at, c in enumerate(subset)) for subset in SUBSETS], axis=1)
                full = np.stack([sums[:, subset].any(axis=1) for subset in SUBSETS], axis=1)
                slack = spare - int((~full).any(axis=1).sum())
                rows = np.repeat(np.arange(n), full.sum(axis=1))
                out.append((words.mix((told + _places(n, band * FAMILIES + family))[full]), rows, band * FAMILIES + family, slack))
                if slack >= 0:
                    break
            else:
                out.append((words.mix(np.array([band + (1 << 60)], np.uint64)), np.zeros(1, np.int64), band * FAMILIES + FAMILIES - 1, 0))
        band += 1
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the elements dealt to ``SKETCH_BITS`` places, as longs.

    An element that only one of two sets has turns one bit, so sets differ in as many elements at least as their
    sketches differ in bits.
    """
    odd = np.bincount((words.mix(shingles) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sizes(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            bits = np.zeros((len(batch), SKETCH_BITS // 64), np.int64)
            for part in words.slices(batch.column("text"), words.BLANK_SPLIT, words.FOLD):
                for i, own in shingle_sets(part, width):
                    n[i], ids[i], bits[i] = len(own), set_id(own), sketch(own)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, SKETCH_BITS // 64, dtype=np.int32)), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("place"), pa.array(n), pa.array(ids), bits], ["row_key", "place", "n_shingles", "node", "sketch"])

    return scan


def _signed(like: Similarity):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in words.slices(batch.column("text"), words.BLANK_SPLIT, words.FOLD):
                hashes, nodes, tags = [], [], []
                for _, own in shingle_sets(part, like.width):
                    if not len(own) or (node := set_id(own)) in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    for hashed, partitions, band, slack in signatures(own, like):
                        hashes.append(hashed.view(np.int64))
                        nodes.append(np.full(len(hashed), node))
                        tags.append((band * 4096 + min(max(slack, 0), 4095) << 32) + partitions)
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tags))], ["signature", "node", "tag"])

    return scan


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch.column("text"), words.BLANK_SPLIT, words.FOLD):
                own = [x for _, x in shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "shingles"])

    return scan


def _checked(like: Similarity):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(like.linked(len(a), len(b), both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scan


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every element of every set, with what is told of its set."""
    for batch in batches:
        for lo in range(0, len(batch), 32):
            part = batch.slice(lo, 32)
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            which = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            size = pa.array([len(x) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), size.take(which), pa.array(np.concatenate(own))], ["node", "known", "size", "element"])


class _Join:
    """The steps of one join; each is a job over all of its input."""

    def __init__(self, docs: DataFrame, like: Similarity):
        self.like = like
        self.docs = in_small_batches(docs).select("row_key", "place", "text")
        self.rows = checkpointed(self.docs.mapInArrow(_sizes(like.width), "row_key long, place long, n_shingles long, node long, sketch array<long>"))
        self.sketches = stored(self.rows.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))

    def members(self) -> DataFrame:
        """``signature, node, tag, low, n`` of every signature that several sets have."""
        signed = self.docs.select("text").mapInArrow(_signed(self.like), "signature long, node long, tag long")
        shared = signed.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").cast("int").alias("n")).filter("low < high").drop("high")
        shared = stored(shared)
        return stored(maybe_in(signed, shared.select("signature"), "signature").join(shared, "signature").distinct())

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node, shingles`` of the named set ids, from one text of each."""
        chosen = self.rows.groupBy("node").agg(F.min("row_key").alias("row_key")).join(nodes.distinct(), "node", "left_semi").select("row_key")
        texts = self.docs.join(maybe_broadcast(checkpointed(chosen)), "row_key", "left_semi").select("text")
        return texts.mapInArrow(_sets(self.like.width), "node long, shingles binary").dropDuplicates(["node"])

    def maybe(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` less those that differ in too many elements by their sizes and sketches alone."""
        one, two = (self.sketches.select(F.col("node").alias(c), F.struct("size", "sketch").alias(x)) for c, x in (("a", "one"), ("b", "two")))
        joined = pairs.join(one, "a").join(two, "b")
        apart = F.aggregate(F.zip_with("one.sketch", "two.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        sizes = F.col("one.size") + F.col("two.size")
        return joined.filter(F.greatest(apart, F.abs(F.col("one.size") - F.col("two.size"))) <= F.floor(F.lit(100 - self.like.percent) * sizes / (100 + self.like.percent))).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` of set ids that are linked by their whole sets."""
        pairs = checkpointed(self.maybe(pairs))
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        sets = self.sets(nodes)
        one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
        return checkpointed(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_checked(self.like), "a long, b long"))

    def cold_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of sets that aren't ``known`` to be in one group and share cold buckets often enough.

        A linked set shares signatures with its partner in more than ``slack`` partitions; at most ``hot_parts`` of
        these have a hot one, so there are ``need`` cold signatures at least that both have.
        """
        cold = members.filter(F.col("n") <= HOT).select("signature", "node", "known", "band", F.greatest(F.col("slack") + 1 - F.col("hot_parts"), F.lit(1)).alias("need"))
        one = cold.select("signature", "band", F.col("node").alias("a"), F.col("known").alias("known_a"), F.col("need").alias("need_a"))
        two = cold.select("signature", F.col("node").alias("b"), F.col("known").alias("known_b"), F.col("need").alias("need_b"))
        apart = (F.col("a") < F.col("b")) & (F.col("known_a") != F.col("known_b"))
        pairs = one.join(two, "signature").filter(apart).groupBy("a", "b", "band").agg(F.count("*").alias("n"), F.max(F.greatest("need_a", "need_b")).alias("need"))
        return pairs.filter("n >= need").select("a", "b").distinct()

    def near_links(self, hot: DataFrame) -> DataFrame:
        """Links, checked on whole sets, between each hot set and one that stands for its buckets.

        In each bucket the set with most hot buckets stands for all, and in a second turn the first by hash. A set
        is checked against the one that stands for most of its buckets, so there are two pairs a set at most, and
        a large group of near copies is mostly one group before any of its pairs are formed.
        """
        turns = [F.struct("hot", "node"), F.struct(F.xxhash64("node").alias("hot"), "node")]
        pairs = []
        for order in turns:
            stands = hot.groupBy("signature").agg(F.max(order)["node"].alias("first"))
            votes = hot.join(stands, "signature").filter("node <> first").groupBy("node", "first").agg(F.count("*").alias("votes"))
            best = votes.groupBy("node").agg(F.max(F.struct("votes", "first"))["first"].alias("first"))
            pairs.append(best.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")))
        return self.links(pairs[0].unionByName(pairs[1]).distinct())

    def hot_pairs(self, hot: DataFrame, known: DataFrame) -> DataFrame:
        """Candidates ``a, b`` among the sets that may share hot buckets only.

        ``near_links`` made groups that are ``known`` by now; only sets of different groups can still be needed. They
        are joined by a prefix filter over whole sets: elements are ordered by the number of these sets that have
        them, rarest first. Two linked sets of sizes s and t have ``need`` elements in common at least, so their
        first common one stands before place s - need + 1 of the one and t - need + 1 of the other. In a large group
        of near copies the sets that are not linked with its bulk begin with more elements of their own than that,
        so they meet none of it. An element of one set or one group only is dropped before the join; of the others,
        rows of the group that most rows with this element belong to only meet those of other groups.
        """
        like = self.like
        sets = self.sets(hot.select("node")).join(known, "node", "left").select("node", F.coalesce("known", "node").alias("known"), "shingles")
        every = sets.mapInArrow(_elements, "node long, known long, size long, element long")
        often = stored(every.groupBy("element").agg(F.count("*").alias("often")).filter("often > 1"))
        shared = maybe_in(every, often.select("element"), "element").join(often, "element")
        ranked = shared.groupBy("node", "known", "size").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("ranked"))
        # Elements of this set only come first; they need no row of their own.
        own = F.col("size") - F.size("ranked")
        most = (F.col("size") - like.least_common(F.col("size"), F.ceil(F.lit(like.percent) * F.col("size") / 100)) + 1 - own).cast("int")
        keys = ranked.filter(most > 0).select("node", "known", "size", own.alias("own"), F.posexplode(F.slice("ranked", F.lit(1), most)).alias("at", "ranked"))
        keys = stored(keys.select("node", "known", "size", (F.col("own") + F.col("at")).alias("at"), F.col("ranked.element").alias("element")))
        groups = keys.groupBy("element", "known").agg(F.count("*").alias("n")).groupBy("element").agg(F.count("*").alias("groups"), F.max(F.struct("n", "known"))["known"].alias("bulk"))
        keys = stored(keys.join(groups.filter("groups > 1").select("element", "bulk"), "element"))
        one = keys.filter("known <> bulk").select("element", F.struct("node", "known", "size", "at").alias("x"))
        two = keys.select("element", F.struct("node", "known", "size", "at").alias("y"))
        need = like.least_common(F.col("x.size"), F.col("y.size"))
        met = one.join(two, "element").filter((F.col("x.known") != F.col("y.known")) & (F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= need))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def components(self) -> DataFrame:
        """``node, component`` of every set that is linked with another one."""
        members = self.members().withColumns({"band": F.expr("cast(shiftright(tag, 44) as int)"), "slack": F.expr("cast(shiftright(tag, 32) & 4095 as int)"), "part": F.expr("cast(tag & 4294967295 as int)")})
        hot = members.filter(F.col("n") > HOT).groupBy("node", "band").agg(F.count("*").alias("hot"), F.count_distinct("part").alias("hot_parts"))
        members = members.join(hot, ["node", "band"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hot", "hot_parts")})
        members = checkpointed(members.drop("tag", "low"))
        hot = checkpointed(members.filter((F.col("n") > HOT) & (F.col("hot_parts") > F.col("slack"))).select("signature", "node", "hot"))
        proven = self.near_links(hot)
        known = checkpointed(connected_components(proven).withColumnRenamed("component", "known"))
        members = members.join(maybe_broadcast(known), "node", "left").withColumn("known", F.coalesce("known", "node"))
        pairs = self.cold_pairs(members).unionByName(self.hot_pairs(hot, known)).distinct()
        return connected_components(proven.unionByName(self.links(pairs)))


def linked(docs: DataFrame, like: Similarity) -> DataFrame:
    """``row_key, place, n_shingles, set`` of each row; ``set`` is one set id for all sets that are linked, null for empty ones.

    ``docs`` has ``row_key`` (unique), ``place`` (the order of documents) and ``text``. Equal sets are one set from
    the start, so copies cost no more than their row. Empty sets are linked with nothing.
    """
    join = _Join(docs, like)
    nodes = join.rows.join(join.components(), "node", "left")
    return nodes.select("row_key", "place", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("set"))


def groups(docs: DataFrame, like: Similarity) -> DataFrame:
    """``row_key, place, n_shingles, component`` of each row; ``component`` is the smallest ``place`` it is linked with."""
    nodes = linked(docs, like)
    lowest = nodes.filter("set is not null").groupBy("set").agg(F.min("place").alias("low"))
    return nodes.join(lowest, "set", "left").select("row_key", "place", "n_shingles", F.coalesce("low", "place").alias("component"))


def similar(docs: DataFrame, like: Similarity) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (``doc_id, text``).

    Texts are lower-cased in A-Z and split at white space; a set holds the distinct ``like.width``-word shingles, a
    shorter text is one shingle. Null and wordless texts have empty sets, linked with nothing. Null ids come after
    all others; a group of only null ids has none. Repeated rows are linked with each other unless empty. An empty
    table gives no rows. Sets are compared by 64-bit shingle hashes.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), smallest_first().alias("place"), F.col("text").cast("string").alias("text"))
    last = F.lit((1 << 63) - 1)
    found = groups(rows, like)
    return found.select(F.nullif("place", last).alias("doc_id"), "n_shingles", F.nullif("component", last).alias("component_id"))


def one_of_each(docs: DataFrame, like: Similarity) -> DataFrame:
    """The rows of ``docs`` that are first by id in their group, with all their columns.

    Groups are told by their texts alone: unlike texts stay, whether their ids are null, repeated or neither. Of
    rows that repeat both id and text one stays. Rows with empty sets are groups of their own.
    """
    key = free_name(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col(key).alias("row_key"), smallest_first().alias("place"), F.col("text").cast("string").alias("text"))
    own = F.when(F.col("n_shingles") == 0, F.col("row_key")).alias("own")
    first = linked(rows, like).groupBy("set", own).agg(F.min(F.struct("place", "row_key"))["row_key"].alias(key)).select(key)
    kept = keyed.join(maybe_broadcast(checkpointed(first)), key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
