"""Operator 12: Merkle manifest of a data set by a butterfly exchange (DataFrame
functions only).

Every row is a leaf: the sha256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  The leaves of a group (a source) ascend by id;
while several nodes remain, every ``fanout`` consecutive ones (the last run may
be shorter, even one) become their hash.  The group roots, ordered by group, are
the leaves of one tree more, whose last node is the root.

1. Leaves get their place in their group from range-partitioned ranks, written
   once.  Consecutive runs of fanout ** depth leaves are the partitions of the
   tree: the aligned subtrees that one group of rows holds and hashes alone.
2. Butterfly: in round r the partitions that differ only in digit r (base
   ``fanout``) of their number swap the roots of the subtrees they have reached.
   Each hashes the swapped roots to its next ancestor and notes those left and
   right of its own as a step of its proof.  So ancestors are hashed by every
   partition below them, and after log_fanout(partitions) rounds each partition
   holds the group's root and all upper steps; nothing is sent back down.  Where
   the last subtree is not full, its last partition swaps in the place of the
   missing ones, as all of a subtree's partitions know the subtree's root.
3. Each partition hashes its own leaves again and gives them their lower steps,
   the upper ones, and the steps from the group's root to the root.

A round moves one small row for each partition (and at most as many again for
missing ones); it ends in a written table, so a lost executor repeats one round.

Defined results: null and empty fields differ (``-`` and ``0:``); null ids come
first, rows of equal id ascend by leaf, and equal rows are leaves of their own; a
null group is the first one; a group of one leaf has that leaf as its root, and a
single group's root is the root; an empty table gives an empty result.  Only the
named columns are read; kept columns called leaf, proof, subroot or root give way
to the operator's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jestframe.llm.common import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
DEPTH = 6
STEP = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields, told apart by their byte counts."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*map(field, fields)))


def group_key(group: Column) -> Column:
    """A non-null key that sorts as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with ``key``) with ``i``, the 0-based place in its key by
    ``order``, and ``last``, the key's last place.

    The partition number as the last range key splits equal rows, which are
    interchangeable, and is the same when a task is repeated."""
    by = ["key", *order]
    rows = (leaves.withColumn("part_", F.spark_partition_id()).repartitionByRange(*by, "part_").sortWithinPartitions(*by, "part_")
            .withColumn("pos_", F.monotonically_increasing_id()).drop("part_"))
    rows = written(rows, "placed").withColumn("range_", F.shiftright("pos_", 33))
    counts = rows.groupBy("key", "range_").agg(F.count(F.lit(1)).alias("n_"), F.min("pos_").alias("first_"))
    whole = Window.partitionBy("key")
    starts = counts.select("key", "range_", "first_", F.coalesce(F.sum("n_").over(whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"),
                           (F.sum("n_").over(whole) - 1).alias("last"))
    return (rows.join(starts, ["key", "range_"]).withColumn("i", F.col("before_") + F.col("pos_") - F.col("first_"))
            .drop("pos_", "range_", "first_", "before_"))


def level_above(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda j: digest(F.array_join(F.slice(nodes, j * fanout + 1, F.lit(fanout)), "")))


def levels(leaves: Column, above: Column, fanout: int, depth: int) -> Column:
    """The node levels over ``leaves``, lowest first, up to ``depth`` steps: all
    of them if other subtrees stand beside this one, else until one node is left."""
    def climb(acc: Column, _: Column) -> Column:
        top = F.element_at(acc, -1)
        return F.when(above | (F.size(top) > 1), F.concat(acc, F.array(level_above(top, fanout)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), climb)


def steps_of(j: Column, tree: Column, fanout: int, depth: int) -> Column:
    """Siblings left and right of leaf ``j`` (0-based) and its ancestors, level by level."""
    def step(level: Column) -> Column:
        nodes, pos = F.get(tree, level), F.floor(j / F.pow(F.lit(float(fanout)), level)).cast("int")
        return F.struct(F.array_join(F.slice(nodes, pos - pos % fanout + 1, pos % fanout), "").alias("before"),
                        F.array_join(F.slice(nodes, pos + 2, fanout - 1 - pos % fanout), "").alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(depth)), F.lit(1), F.size(tree) - 1), step)


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """key, p (partition), last (its key's last), node (its subtree's root) ->
    key, p, node (its key's root), steps (the upper ones)."""
    state = written(blocks.select("key", "p", "last", "node", F.array().cast(f"array<{STEP}>").alias("steps")), "round")
    span, most = 1, state.agg(F.max("last")).first()[0] or 0
    while span <= most:
        digit = F.expr(f"p div {span} % {fanout}")
        sent = state.select("*", F.expr(f"p % {span}").alias("low"), digit.alias("digit"), F.lit(True).alias("own"))
        missing = (sent.where((F.col("p") == F.col("last")) & (F.col("digit") > 0) & (F.col("low") < span - 1))
                   .withColumn("low", F.explode(F.sequence(F.col("low") + 1, F.lit(span - 1).cast("long")))).withColumn("own", F.lit(False)))
        met = (sent.unionByName(missing).groupBy("key", F.expr(f"p div {span * fanout}").alias("group"), "low")
               .agg(F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct("digit", "node", "p", "own", "steps"))).alias("m")))
        nodes = F.col("m.node")
        swapped = F.transform(F.filter("m", lambda x: x["own"]), lambda x: F.struct(
            x["p"].alias("p"), x["steps"].alias("steps"),
            F.struct(F.array_join(F.slice(nodes, F.lit(1), x["digit"].cast("int")), "").alias("before"),
                     F.array_join(F.slice(nodes, x["digit"].cast("int") + 2, F.lit(fanout)), "").alias("after")).alias("step")))
        # a key whose partitions have all met keeps its root
        on = F.col("last") >= span
        state = written(met.select("key", "last", F.when(on, digest(F.array_join(nodes, ""))).otherwise(nodes[0]).alias("node"), F.explode(swapped).alias("x"))
                        .select("key", "x.p", "last", "node", F.when(on, F.concat("x.steps", F.array("x.step"))).otherwise(F.col("x.steps")).alias("steps")), "round")
        span *= fanout
    return state.select("key", "p", "node", "steps")


def trees(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """key, i, last, leaf, kept -> key, leaf, kept, steps (to the key's root), node (that root)."""
    size = fanout ** depth
    above = F.col("last") > 0
    blocks = (leaves.groupBy("key", F.expr(f"i div {size}").alias("p"))
              .agg(F.first(F.expr(f"last div {size}")).alias("last"), F.sort_array(F.collect_list(F.struct("i", "leaf", "kept"))).alias("rows"))
              .select("key", "p", "last", "rows", levels(F.col("rows.leaf"), above, fanout, depth).alias("tree")))
    blocks = written(blocks, "subtrees")
    upper = butterfly(blocks.select("key", "p", "last", F.element_at(F.element_at("tree", -1), 1).alias("node")), fanout)
    lower = F.transform("rows", lambda r: F.struct(r["leaf"].alias("leaf"), r["kept"].alias("kept"), steps_of((r["i"] % size).cast("int"), F.col("tree"), fanout, depth).alias("lower")))
    return (blocks.withColumn("own", lower).join(upper, ["key", "p"]).select("key", "node", F.col("steps").alias("upper"), F.explode("own").alias("x"))
            .select("key", "x.leaf", "x.kept", F.concat("x.lower", "upper").alias("steps"), "node"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the steps of a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, *, id_col: str = "doc_id", group_col: str = "source",
             keep: Sequence[str] = ("doc_id", "source"), fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """The ``keep`` columns of every row with leaf, proof (its steps: siblings
    before and after, level by level up to the root), subroot and root."""
    keep = [c for c in keep if c.lower() not in ("leaf", "proof", "subroot", "root")]
    leaves = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
                         F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    # collect_list's sort never reaches ``kept``: places are unique
    own = trees(placed(leaves, ["id", "leaf"]), fanout, depth)
    own = written(own, "proofs-of-groups")
    groups = own.groupBy("key").agg(F.first("node").alias("leaf"))
    top = placed(groups.select(F.lit("").alias("key"), F.col("key").alias("id"), "leaf", F.struct(F.col("key")).alias("kept")), ["id"])
    top = trees(top, fanout, depth).select("kept.key", F.col("steps").alias("top"), F.col("node").alias("root"))
    return own.join(top, "key").select(*[F.col(f"kept.{c}") for c in keep], "leaf", F.concat("steps", "top").alias("proof"), F.col("node").alias("subroot"), "root")
