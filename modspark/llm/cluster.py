"""Links between rows that share a bucket, and the classes they make, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.llm.common import stored

BLOCK = 32  # members of a block of a large bucket; each block meets each
SMALL = 16  # members of a bucket in which all meet


def bucket_members(rows: DataFrame) -> DataFrame:
    """``(band, id, first)`` of every bucket with more than one member; ``rows`` has ``id`` and ``bands``.

    Least and largest id of a bucket are combined before the shuffle. A bucket's members meet
    them in a join, whose large partitions Spark splits.
    """
    buckets = rows.select("id", F.explode("bands").alias("band"))
    full = buckets.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    full = full.where("first < last").select("band", "first")
    return stored(buckets.join(full, "band").select("band", "id", "first"), "members")


def members_of(buckets: DataFrame) -> DataFrame:
    """``(band, id, first)`` of every bucket of ``buckets(id, band)`` with more than one member.

    For very many buckets, nearly all of one member: rows are shuffled once, and what is counted of a
    bucket is joined to it where it lies.
    """
    dealt = buckets.repartition("band")
    full = dealt.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return stored(dealt.join(full.hint("merge"), "band").select("band", "id", "first").distinct(), "members")


def are_stars(edges: DataFrame) -> bool:
    """Is each component of ``edges(u, v)``, u above v, a star around its least id?"""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return (each.agg(F.max(F.col("up") + F.col("down"))).first()[0] or 0) < 2


def connected(links: DataFrame, name: str) -> DataFrame:
    """``(id, root)``: the smallest id of the connected component of every id in ``links(a, b)``.

    Alternates large-star and small-star steps until each component is a star; each result is written
    to the shared folder. Only one number comes to the driver, to see that.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    while not are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the least of its neighbourhood, one row for each edge.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: neighbours below a node, and the node, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, name)
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v").distinct())


def still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(band, id, root, n)``: members of buckets that hold more than one class, and how many there are."""
    now = members.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    bands = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    return stored(now.join(bands.where("low < high").select("band", "n"), "band"), "apart")


def small_pairs(apart: DataFrame) -> DataFrame:
    """Each two of different classes in buckets of up to ``SMALL`` members."""
    few = apart.where(F.col("n") <= SMALL)
    other = few.select("band", F.col("id").alias("id_b"), F.col("root").alias("root_b"))
    return few.join(other, "band").where("id < id_b and root <> root_b").select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def block_pairs(apart: DataFrame) -> DataFrame:
    """Each two of different classes in larger buckets.

    A bucket is dealt into blocks of about ``BLOCK`` members, standing in a circle. A block meets itself and
    those of half the circle, so each block meets each. A task's rows are those of single block
    pairs, whatever the bucket's size.
    """
    many = apart.where(F.col("n") > SMALL).withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    many = many.withColumn("block", F.expr("pmod(xxhash64(id, band), blocks)"))
    on = many.withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("blocks div 2"))))
    on = on.select("band", "id", "root", "step", F.expr("pmod(block + step, blocks)").alias("block"))
    other = many.select("band", "block", F.col("id").alias("id_b"), F.col("root").alias("root_b"))
    pairs = on.join(other, ["band", "block"]).where("root <> root_b and (step > 0 or id < id_b)")
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))


def _representatives(apart: DataFrame) -> DataFrame:
    """In larger buckets the least member of each class meets the least member of the bucket's largest class."""
    each = apart.where(F.col("n") > SMALL).groupBy("band", "root").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    main = each.groupBy("band").agg(F.max(F.struct("size", "id")).alias("main")).select("band", F.col("main.id").alias("main"))
    pairs = each.join(main, "band").where("id <> main")
    return pairs.select(F.least("id", "main").alias("a"), F.greatest("id", "main").alias("b"))


def linked(members: DataFrame, verified: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame] = block_pairs) -> tuple[DataFrame, DataFrame]:
    """Confirmed links ``(a, b)``, and ``(id, root)`` of their components.

    ``verified`` returns those of some pairs that hold. A member meets the least one of a bucket, then, if
    that does not hold, up to three more such. In larger buckets classes then meet by representatives.
    What is left are members that share a bucket and not a class: in buckets of up to ``SMALL`` all of
    these meet, in larger ones those that ``large`` returns, which must leave out only
    pairs that can't hold. So in the end any two of a bucket are in one class, were compared, or can't hold.
    """
    turn = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = stored(stars.withColumn("turn", turn), "stars")
    tried = stars.where("turn = 1").select("a", "b")
    links = stored(verified(tried), "links")
    again = stars.where(F.col("turn").between(2, 4)).join(links.select("b").distinct(), "b", "left_anti").select("a", "b")
    again = stored(again, "pairs")
    if again.take(1):
        tried, links = tried.union(again), links.union(stored(verified(again), "links"))
    roots = connected(links, "components")
    steps = [_representatives, lambda apart: small_pairs(apart).union(large(apart))]
    for pairs in steps:
        todo = pairs(still_apart(members, roots)).distinct().join(tried, ["a", "b"], "left_anti")
        todo = stored(todo, "pairs")
        if not todo.take(1):
            continue
        new = stored(verified(todo), "links")
        tried, links = tried.union(todo), links.union(new)
        if new.take(1):
            # What was one component is a star by now; new links join stars.
            roots = connected(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(new), "components")
    return links, roots
