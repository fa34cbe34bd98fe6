"""Connected components and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and self loops don't matter, rows with a
    null end are ignored. Returns ``node, component``. Alternating large-star and small-star rounds: each is two
    aggregations with map-side combine and one equi-join that adaptive execution can split, so a node with very
    many neighbours never meets in one task. Every round is checkpointed, so plans stay short and a lost
    executor costs one round at most. Rounds go on until nothing changes. No edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = edges.filter("a is not null and b is not null and a <> b")
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == size:
            break
        size = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def grouped_scenes(scenes: DataFrame, edges: DataFrame, scene: str, ratio: str) -> DataFrame:
    """Scenes with their group: component, visit order, neighbours in the group, size and canonical scene.

    A scene without edges is its own group. The canonical scene is the one of lowest ``ratio``, the first on ties.
    """
    found = connected_components(edges).withColumnRenamed("node", scene)
    out = scenes.join(found, scene, "left").withColumn("component", F.coalesce("component", F.col(scene).cast("long")))
    by = Window.partitionBy("component")
    order = by.orderBy(scene)
    return out.withColumns(
        {
            "visit_order": F.row_number().over(order),
            "previous": F.lag(scene).over(order),
            "next": F.lead(scene).over(order),
            "group_size": F.count("*").over(by),
            "canonical": F.min(F.struct(F.col(ratio).alias("r"), F.col(scene).alias("s"))).over(by)["s"],
        }
    )


def adjacent_components(rows: DataFrame, keys: list[str], scene: str, merged: str) -> DataFrame:
    """Components where only neighbours can be joined: runs in which each row is merged with the one before."""
    by = Window.partitionBy(*keys).orderBy(scene)
    start = F.when(F.coalesce(F.col(merged), F.lit(False)) & F.lag(scene).over(by).isNotNull(), F.lit(None)).otherwise(F.col(scene))
    return rows.withColumn("component", F.last(start, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def resolved_groups(scenes: DataFrame, results: DataFrame, scene: str, least: float) -> DataFrame:
    """Scenes with the group that reviews of pairs put them in, under vetoes, dropped scenes and chosen representatives.

    ``results`` have ``a, b, decision, confidence, representative``. A review counts from a confidence of ``least`` on. A pair
    that one review calls ``same_slide`` is joined unless another calls it ``different_slide``; a scene that one calls
    ``transition_noise`` (as ``a``) is dropped: it joins nothing and is a group of its own. A group's canonical scene is the
    first that a joining review of its own pairs names as representative, else its first. Returns ``scene, canonical,
    group_size, visit_order, previous, next, vetoed, dropped, preferred, manual``: ``vetoed`` where a counting review of the
    scene says ``different_slide``, ``manual`` where any says ``uncertain`` and the scene isn't dropped.

    Pairs are taken either way round; nulls join nothing; reviews of unknown scenes don't matter; an empty table of
    reviews leaves each scene alone.
    """
    own = scenes.select(F.col(scene).cast("long").alias("scene")).filter("scene is not null").distinct()
    told = results.select(F.least("a", "b").cast("long").alias("x"), F.greatest("a", "b").cast("long").alias("y"), F.col("a").cast("long").alias("a"), "decision", F.coalesce(F.col("confidence") >= least, F.lit(False)).alias("sure"), F.col("representative").cast("long").alias("chosen"))
    told = told.filter("a is not null")
    dropped = told.filter("decision = 'transition_noise' and sure").select(F.col("a").alias("scene")).distinct()
    pairs = told.filter("sure and x <> y").groupBy("x", "y").agg(F.max((F.col("decision") == "same_slide").cast("int")).alias("same"), F.max((F.col("decision") == "different_slide").cast("int")).alias("apart"), F.min(F.when(F.col("decision") == "same_slide", F.col("chosen"))).alias("chosen"))
    free = own.join(dropped, "scene", "left_anti")
    for end in ("x", "y"):
        pairs = pairs.join(free.withColumnRenamed("scene", end), end, "left_semi")
    joined = checkpointed(pairs.filter("same = 1 and apart = 0").select("x", "y", "chosen"))
    groups = own.join(connected_components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "scene"), "scene", "left")
    groups = groups.withColumn("component", F.coalesce("component", "scene"))
    # A representative counts in the group of the pair that names it.
    named = joined.filter("chosen is not null").select(F.col("x").alias("scene"), "chosen").join(groups, "scene").select("component", F.col("chosen").alias("scene")).join(groups, ["component", "scene"])
    heads = named.groupBy("component").agg(F.min("scene").alias("head"))
    ends = told.select(F.explode(F.array("x", "y")).alias("scene"), "decision", "sure")
    marks = ends.groupBy("scene").agg(F.max(F.col("sure") & (F.col("decision") == "different_slide")).alias("vetoed"), F.max(F.col("decision") == "uncertain").alias("open"))
    by = Window.partitionBy("component")
    order = by.orderBy("scene")
    out = groups.join(heads, "component", "left").join(marks, "scene", "left").join(dropped.withColumn("_dropped", F.lit(True)), "scene", "left")
    gone = F.coalesce("_dropped", F.lit(False))
    return out.select(
        "scene",
        F.coalesce("head", "component").alias("canonical"),
        F.count("*").over(by).alias("group_size"),
        F.row_number().over(order).cast("long").alias("visit_order"),
        F.lag("scene").over(order).alias("previous"),
        F.lead("scene").over(order).alias("next"),
        F.coalesce("vetoed", F.lit(False)).alias("vetoed"),
        gone.alias("dropped"),
        F.coalesce(F.col("head") == F.col("scene"), F.lit(False)).alias("preferred"),
        (F.coalesce("open", F.lit(False)) & ~gone).alias("manual"),
    )


def block_boundaries(candidates: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Candidate pairs ``left, right`` moved to the ends of their provisional blocks.

    ``candidates`` have ``key, kind, a, b``, ``blocks`` ``scene, start, end``. Duplicates go from the end of the earlier
    scene's block to the start of the later one's, and fall away where these don't lie apart; a scene without a block is
    one. Candidates of any other kind keep their pair as it is.
    """
    rows = candidates.select(key, "kind", F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
    ends, starts = blocks.select(F.col("scene").alias("left"), F.col("end").alias("_end")), blocks.select(F.col("scene").alias("right"), F.col("start").alias("_start"))
    rows = rows.join(ends, "left", "left").join(starts, "right", "left")
    moved = F.col("kind") == "same_slide_duplicate"
    rows = rows.select(key, "kind", F.when(moved, F.coalesce("_end", "left")).otherwise(F.col("left")).alias("left"), F.when(moved, F.coalesce("_start", "right")).otherwise(F.col("right")).alias("right"))
    return rows.filter(F.coalesce(F.col("kind") != "same_slide_duplicate", F.lit(True)) | (F.col("left") < F.col("right")))
