"""Neighbours in Hamming space: bit strings within a distance of one another, and the classes they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.graph import connected_components
from evidentia.sources.session import checkpointed, stored

#: A bucket of more bit strings is cut again by the bits that it doesn't fix.
CROWDED = 64
#: How often a bucket is cut.
LEVELS = 3


def distance(a: Column, b: Column) -> Column:
    """The bits that differ between two arrays of longs of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def digits(words: Column) -> Column:
    """The bits of an array of longs as hexadecimal digits, in order."""
    return F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def difference_hash(cells: Column, size: int) -> Column:
    """``size`` bits (a multiple of 64) as longs: whether each of the ``size + 1`` cells is below the one after it.

    Bits of words run from the highest; cells that are missing or null give 0.
    """
    bits = F.zip_with(F.slice(cells, 1, size), F.slice(cells, 2, size), lambda x, y: F.when(x < y, "1").otherwise("0"))
    text = F.rpad(F.array_join(bits, ""), size, "0")
    return F.array(*[F.conv(F.substring(text, at, 64), 2, -10).cast("long") for at in range(1, size, 64)])


def _cut(rows: DataFrame, within: int) -> DataFrame:
    """Each row once for every band of the digits that are still free, with the band in its ``bucket``.

    Two strings of one bucket agree on all bits that it fixes. Within ``within`` of one another they differ in as
    many of the others at most, so of ``within + 1`` bands of these at least one is the same.
    """
    bands, size = within + 1, F.length("free")
    lo = lambda k: F.floor(k * size / bands).cast("int")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(within)), lambda k: F.struct(lo(k).alias("lo"), lo(k + 1).alias("hi")))).alias("k", "b")
    rows = rows.select("bucket", "node", "words", "free", band).filter("b.hi > b.lo")
    own = F.expr("substring(free, b.lo + 1, b.hi - b.lo)")
    rest = F.concat(F.expr("substring(free, 1, b.lo)"), F.expr("substring(free, b.hi + 1)"))
    return rows.select(F.concat_ws("|", "bucket", F.concat_ws(":", "k", own)).alias("bucket"), "node", "words", rest.alias("free"))


def _buckets(nodes: DataFrame, within: int) -> DataFrame:
    """``bucket, node, words``: strings within ``within`` of one another share a bucket; crowded ones are cut again."""
    rows, done = nodes.select(F.lit("").alias("bucket"), "node", "words", digits(F.col("words")).alias("free")), []
    for level in range(LEVELS):
        rows = _cut(rows, within)
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stored(rows.join(sizes, "bucket"))
        last = level == LEVELS - 1
        # A band needs a digit of its own; without free digits a bucket can't be cut.
        crowded = F.lit(False) if last else (F.col("n") > CROWDED) & (F.length("free") > within)
        done.append(rows.filter(~crowded).select("bucket", "node", "words"))
        rows = rows.filter(crowded).select("bucket", "node", "words", "free")
        if last or rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_pairs(nodes: DataFrame, within: int) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``node long, words array<long>``, distinct words) that are within a distance.

    In each bucket one string stands for all within half the distance of it: these are linked with it, hence with
    each other by way of it, and none of their own pairs is formed. All others are joined with the whole bucket. So
    the pairs make the same classes as all pairs within the distance, and a dense group costs one pair a string.
    """
    rows = stored(_buckets(nodes, within))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("node", "words")).alias("head"))
    rows = rows.join(heads, "bucket").withColumn("away", distance(F.col("words"), F.col("head.words")))
    stars = rows.filter(f"away <= {within // 2} and node <> head.node").select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    rest = rows.filter(f"away > {within // 2}").select("bucket", F.col("node").alias("x"), F.col("words").alias("wx"))
    every = rows.select("bucket", F.col("node").alias("y"), F.col("words").alias("wy"))
    met = rest.join(every, "bucket").filter((F.col("x") != F.col("y")) & (distance(F.col("wx"), F.col("wy")) <= within))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(met).distinct()


def classes(rows: DataFrame, key: str, words: str, within: int) -> DataFrame:
    """``rows`` and ``representative``, ``class_size``: the smallest key that chains of strings within ``within`` lead to.

    ``key`` is a unique long, ``words`` an array of longs of one length in all rows. Equal strings are one from the
    start, so copies cost no more than their row; no group meets in one task and no pairs of a whole group are
    formed. The search is exact: pigeonhole bands, no sampling and no cap. Rows whose words are null are classes of
    their own, an empty table gives no rows.
    """
    own = rows.withColumn("_words", F.col(words))
    nodes = checkpointed(own.filter("_words is not null").groupBy(F.col("_words").alias("words")).agg(F.min(F.col(key).cast("long")).alias("node")))
    found = connected_components(near_pairs(nodes, within))
    found = nodes.join(found, "node", "left").select(F.col("words").alias("_words"), F.coalesce("component", "node").alias("representative"))
    out = own.join(found, "_words", "left").withColumn("representative", F.coalesce("representative", F.col(key).cast("long"))).drop("_words")
    sizes = out.groupBy("representative").agg(F.count("*").alias("class_size"))
    return out.join(sizes, "representative")
