"""Problem 7: splits that keep related records together.

Records that share a key (thread, author, cited document) are linked to the smallest record of the key, so a key of m
records gives m - 1 links, never all pairs. Borůvka rounds contract each component along its smallest link to another
component; the chosen links are written as a spanning forest. Groups are then stratified by size band and dealt to the
splits systematically: at the place of their middle in the running total of their band.

A null or blank key relates nothing. A record id that stands in both tables, or is delivered again, is one record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.forms import consistent
from tamarack.operators.skew import bounded, lookup
from tamarack.session import materialise

#: Buckets of the running total within a size band at least, and groups for which there is one bucket more: no task
#: orders more than a bucket of a band.
BUCKETS, BUCKET = 256, 1_000_000
# Fixed value: a document number such as 12/2001/XX-YY, in any case and with spaces around its signs.
DOCUMENT_NUMBER = r"(?iu)(?<![\p{L}\p{N}])(\d+\s*/\s*\d{4}\s*/\s*\p{L}{2,}(?:\s*-\s*\p{L}{2,})+)"


def document_numbers(text: Column) -> Column:
    """Array of the document numbers cited in a text, without spaces and in upper case."""
    found = F.regexp_extract_all(consistent(text), F.lit(DOCUMENT_NUMBER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"(?U)\s+", ""))))


def key_table(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(record_id, key) of records (record_id, ...); ``keys`` gives for each kind of key an array column."""
    named = [F.transform(F.coalesce(column, F.array().cast("array<string>")), _prefixed(kind)) for kind, column in keys.items()]
    return records.select("record_id", F.explode(F.concat(*named)).alias("key")).where("key IS NOT NULL").distinct()


def _prefixed(kind: str):
    return lambda x: F.concat(F.lit(kind + ":"), x)


def links(keyed: DataFrame) -> DataFrame:
    """(a, b, w): each record of a key linked to the key's smallest record; ``w`` orders links, ties by their ends."""
    least = keyed.groupBy("key").agg(F.min("record_id").alias("b"), F.count("*").alias("m")).where("m > 1")
    met = lookup(keyed, least, ["key"], "m").where("record_id <> b")
    return met.groupBy(F.col("record_id").alias("a"), "b").agg(F.min(F.xxhash64("key")).alias("w"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, forest) of edges (a, b, w).

    components: (record_id, root), root the smallest record id of its component; forest: the links (a, b) that the
    rounds chose, written before the next round. Every round at least halves the components that have a link left.
    """
    edges = materialise(edges, "edges")
    members = materialise(edges.select(F.col("a").alias("record_id")).union(edges.select("b")).distinct().withColumn("root", F.col("record_id")), "members")
    live = edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"))
    forest: list[DataFrame] = []
    while not live.isEmpty():
        order = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        both = live.select(F.col("x").alias("c"), F.col("y").alias("to"), order.alias("o")).union(live.select(F.col("y"), F.col("x"), order))
        picked = materialise(both.groupBy("c").agg(F.min(F.struct("o", "to")).alias("p")).select("c", F.col("p.to").alias("to"), F.col("p.o.lo").alias("a"), F.col("p.o.hi").alias("b")), "picked")
        forest.append(picked.select("a", "b").distinct())
        # Each component points to its choice; of two that chose each other the smaller is the root.
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parents = picked.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("parent"))
        parents = materialise(parents, "parents")
        while True:  # pointer jumping: depth halves each time
            up = parents.select(F.col("c").alias("parent"), F.col("parent").alias("above"))
            jumped = materialise(parents.join(up, "parent", "left").select("c", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "jumped")
            parents = jumped.select("c", "parent")
            if jumped.where("moved").isEmpty():
                break
        members = members.join(parents.withColumnRenamed("c", "root"), "root", "left").select("record_id", F.coalesce("parent", "root").alias("root"))
        members = materialise(members, "members")
        for end in ("x", "y"):  # every component of a live link has a parent; a hub's links are looked up where they lie
            sizes = live.groupBy(end).agg(F.count("*").alias("m"))
            moved = parents.select(F.col("c").alias(end), F.col("parent").alias("up")).join(sizes, end)
            live = lookup(live, moved, [end], "m").drop(end).withColumnRenamed("up", end).select("a", "b", "w", "x", "y")
        live = materialise(live.where("x <> y"), "live")
    least = members.groupBy("root").agg(F.min("record_id").alias("group_id"))
    components = members.join(least, "root").select("record_id", F.col("group_id").alias("root"))
    return components, reduce(DataFrame.union, forest, edges.select("a", "b").limit(0))


def deal(groups: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """(group_id, size, split) of groups (group_id, size): each size band is dealt in the proportions ``shares``.

    Groups of a band stand in the order of a hash; a group goes to the split that holds the middle of its stretch of
    the band's running total. The running total is summed by bucket first, so that no task orders a whole band.
    """
    total = sum(share for _, share in shares)
    banded = groups.withColumn("band", F.floor(F.log2(F.col("size"))).cast("int")).withColumn("h", F.xxhash64("group_id"))
    buckets = max(BUCKETS, -(-groups.count() // BUCKET))
    banded = banded.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = banded.groupBy("band", "bucket").agg(F.sum("size").alias("s"))
    whole = Window.partitionBy("band")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("band", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"), F.sum("s").over(whole).alias("all"))
    inner = Window.partitionBy("band", "bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = banded.withColumn("upto", F.sum("size").over(inner)).join(bounded(sums), ["band", "bucket"])
    middle = (F.col("offset") + F.col("upto") - F.col("size") / 2) / F.col("all")
    split, upto = F.lit(shares[-1][0]), []
    running = 0.0
    for name, share in shares:
        running += share / total
        upto.append((name, running))
    for name, bound in reversed(upto[:-1]):
        split = F.when(middle < bound, F.lit(name)).otherwise(split)
    return placed.select("group_id", "size", split.alias("split"))


def related_groups(records: DataFrame, keys: dict[str, Column], forest_path: str | None = None) -> DataFrame:
    """(record_id, group_id) of the records that are related to another record.

    ``forest_path`` is a folder in which the spanning forest (a, b) is kept as Parquet, so that later runs can tell why
    two records are in one group, or add links to it.
    """
    components, forest = spanning_forest(links(key_table(records, keys)))
    if forest_path is not None:
        forest.distinct().write.mode("overwrite").parquet(forest_path)
    return components.select("record_id", F.col("root").alias("group_id"))


def assign(records: DataFrame, grouped: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """(record_id, group_id, split) of every record; unrelated records are groups of their own."""
    every = records.select("record_id").where("record_id IS NOT NULL").distinct().join(grouped, "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))
    every = materialise(every, "every")
    dealt = deal(materialise(every.groupBy("group_id").agg(F.count("*").alias("size")), "groups"), shares)
    return every.join(dealt, "group_id").select("record_id", "group_id", "split")
