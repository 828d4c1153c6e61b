"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the tree are the combinations of the level columns (say domain, language, source). Each leaf can give
its tokens times the allowed epochs; a node can give what its children give. From the root down, a node's budget goes
to its children by weight; what a child cannot use goes to its siblings by weight, so that a shortage leaves a node
only when all children of it are full. Budgets are whole tokens: what rounding down leaves goes to the largest remainders, so
the children of a node add up to its own. A leaf's budget is met by whole seeded epochs and the longest prefix of one
more that stays within the rest.

Budgets are window functions over one row per node. Rows are ordered by a hash of key and text. The prefix is found by the
hash at which it ends: sums over first digits give the bucket in which the budget runs out, sums over second digits the
bucket within that one, sums over its hashes the hash. Documents then compare their own hash with it, so no text is shuffled
but those of the rows of that one hash, which are copies; as many of them as fit are taken, numbered part by part. Neither
a leaf nor a key nor copies of one row with a third of all rows are a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planshift.llm.quality import words_of
from planshift.llm.shared import FIRST_DIGITS, copy_numbers, digits_of, hash_fraction, key_text, small_side, stored


def word_tokens(text: str) -> Column:
    """Tokens of a text counted as its words, one at least, so that empty texts are limited too."""
    return F.greatest(F.size(words_of(F.coalesce(F.col(text), F.lit("")))), F.lit(1)).cast("long")


def shared_out(children: DataFrame, parent: Sequence[str], node: Sequence[str]) -> DataFrame:
    """Adds ``__budget``: ``__given`` of the parent poured over the children by ``__w``, none beyond its ``__cap``; all whole numbers.

    Children are filled in the order of capacity per weight: one is full if the rest of the budget, spread by weight
    over it and those after it, reaches its capacity. The level at the first that is not full is the highest of those
    that are not full, and all others get their weight times it.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("__cap") / F.col("__w")), *node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.greatest(F.col("__given") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), F.lit(0.0))
    ahead = F.greatest(F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)), F.col("__w"))
    level = left / ahead
    tight = F.col("__level") < F.col("__cap") / F.col("__w")
    poured = children.withColumn("__level", level).withColumn("__water", F.max(F.when(tight, F.col("__level"))).over(whole))
    exact = F.least(F.col("__cap"), F.coalesce(F.col("__water") * F.col("__w"), F.col("__cap")))
    floors = poured.withColumn("__exact", exact).withColumn("__budget", F.floor("__exact").cast("long"))
    open_ones = F.col("__budget") < F.col("__cap")
    left_over = F.least(F.max("__given").over(whole), F.sum("__cap").over(whole)) - F.sum("__budget").over(whole)
    largest = Window.partitionBy(*parent).orderBy(F.when(open_ones, 0).otherwise(1), F.desc(F.col("__exact") - F.col("__budget")), *node)
    more = F.when(open_ones & (F.row_number().over(largest) <= left_over), 1).otherwise(0)
    return floors.withColumn("__more", more).withColumn("__budget", F.col("__budget") + F.col("__more")).drop(
        "__level", "__water", "__exact", "__more"
    )


def budgets(leaves: DataFrame, levels: Sequence[str], weights: DataFrame | None, total: int) -> DataFrame:
    """Budget of every leaf in whole tokens, ``total`` in all or what the leaves can hold.

    ``leaves`` has the level columns and ``__cap`` in whole tokens; ``weights`` the level columns and ``weight``.

    A row of ``weights`` names a node by its level values, null below its level. A node without weight has the square
    root of its capacity, which evens large and small sources out.
    """
    down = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("__cap").alias("__cap"))
        weight = F.sqrt("__cap")
        if weights is not None:
            named = weights.filter(F.col(path[-1]).isNotNull())
            for below in levels[depth:]:
                named = named.filter(F.col(below).isNull())
            nodes = nodes.join(named.select(*path, F.col("weight").cast("double").alias("__own")), path, "left")
            weight = F.coalesce("__own", weight)
        nodes = nodes.withColumn("__w", F.greatest(weight, F.lit(1e-9)))
        nodes = nodes.join(down, parent) if parent else nodes.withColumn("__given", F.lit(total).cast("long"))
        down = shared_out(nodes, parent, path).select(*path, F.col("__budget").alias("__given"))
    return down.withColumnRenamed("__given", "__budget")


# The order of the rows of a leaf: a hash of key and text, with its first digits as buckets.
DIGITS = ("__d1", "__d2", "__h")


def order_of(key: str, text: str, seed: int) -> dict[str, Column]:
    """The columns of ``DIGITS`` for the rows of a table."""
    content = F.crc32(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")).cast("string")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), content))
    d1, d2 = digits_of(hash_fraction(h), FIRST_DIGITS)
    return {"__d1": d1, "__d2": d2, "__h": h}


def cut_rows(rows: DataFrame, leaf: Sequence[str], rest: DataFrame) -> DataFrame:
    """Per leaf the hash ``__stop`` at which the longest prefix whose tokens stay within ``__rest`` ends, and ``__fit``,
    how many rows of that hash are in it.

    Each step keeps, per leaf, the one digit in which the running sum passes the rest; leaves that end before any such
    digit are not returned: all their rows fit. Rows of one hash are copies, with the same tokens.
    """
    left, steps = rest.select(*leaf, F.col("__rest").alias("__left")), []
    for digit in DIGITS:
        keys = [*leaf, *steps]
        sums = rows.join(left, keys).groupBy(*keys, digit).agg(
            F.sum("__tokens").alias("__s"), F.max("__tokens").alias("__one"), F.first("__left").alias("__left")
        )
        run = Window.partitionBy(*keys).orderBy(digit)
        sums = sums.withColumn("__upto", F.sum("__s").over(run)).filter(F.col("__upto") > F.col("__left"))
        inside = (F.col("__left") - F.col("__upto") + F.col("__s")).alias("l")
        first = sums.groupBy(*keys).agg(F.min_by(F.struct(digit, "__one", inside), digit).alias("__x"))
        steps.append(digit)
        left = first.select(*keys, f"__x.{digit}", "__x.__one", F.col("__x.l").alias("__left"))
        left = stored(left if digit == DIGITS[-1] else left.drop("__one"), "mix-digits")
    return left.select(*leaf, F.col("__h").alias("__stop"), F.expr("__left div __one").alias("__fit"))


def mixed(
    docs: DataFrame,
    levels: Sequence[str],
    share: float = 0.8,
    epochs: int = 2,
    weights: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    seed: int = 29,
) -> DataFrame:
    """The rows of ``docs`` chosen for a mixture of ``share`` times the tokens of ``docs``, with ``epoch`` (from 0).

    A row comes back once for every epoch it is in: all rows of a leaf in its whole epochs, a seeded prefix in the last.
    An ``epoch`` column of ``docs`` is replaced; all others stay, but names that begin with two underscores are taken.
    Null level values are values like any other, null and empty texts count one token. Rows that repeat a key are cut
    one by one, and so are copies of a row. If all leaves together cannot meet the budget, everything is taken ``epochs``
    times. An empty table gives no rows.
    """
    docs = docs.drop("epoch")
    count = word_tokens(text) if tokens is None else tokens
    leaf = [f"__l{i}" for i in range(len(levels))]
    leaf_of = {c: key_text(name) for c, name in zip(leaf, levels, strict=True)}
    narrow = docs.select(*[c.alias(name) for name, c in (leaf_of | order_of(key, text, seed)).items()], count.alias("__tokens"))
    narrow = stored(narrow, "mix-rows")
    leaves = stored(
        narrow.groupBy(*leaf).agg(F.sum("__tokens").alias("__has"), F.count(F.lit(1)).alias("__n")), "mix-leaves"
    )
    total, n_leaves = leaves.agg(F.sum("__has"), F.count(F.lit(1))).first()
    if weights is not None:
        weights = weights.select(
            *[F.when(F.col(n).isNotNull(), key_text(n)).alias(c) for c, n in zip(leaf, levels, strict=True)], "weight"
        )
    capable = leaves.withColumn("__cap", F.col("__has") * epochs)
    # a share is a decimal fraction: what its double adds or takes in the tenth digit is no token
    wanted = int(min(share, epochs) * (total or 0) * (1 + 1e-12) + 1e-9)
    plan = budgets(capable, leaf, weights, wanted).join(leaves.select(*leaf, "__has"), leaf)
    plan = plan.withColumn("__full", F.expr("cast(__budget div __has as int)"))
    plan = stored(plan.withColumn("__rest", F.col("__budget") - F.col("__full") * F.col("__has")), "mix-plan")
    partial = plan.filter(F.col("__rest") >= 1)
    stops = partial.select(*leaf).join(cut_rows(narrow, leaf, partial), leaf, "left").withColumn("__more", F.lit(1))
    plan = stored(plan.join(stops, leaf, "left").select(*leaf, "__full", "__more", "__stop", "__fit"), "mix-cuts")
    picked = docs.withColumns(leaf_of | {"__h": order_of(key, text, seed)["__h"]}).join(small_side(plan, n_leaves, 1024), leaf)
    before = F.col("__stop").isNull() | (F.col("__h") < F.col("__stop"))
    sure = picked.withColumn("__times", F.col("__full") + F.when(F.col("__more").isNotNull() & before, 1).otherwise(0))
    # of the rows at which a leaf is cut, copies of one row, as many as fit
    last = stored(picked.filter("__h = __stop").withColumn("__piece", F.spark_partition_id()), "mix-last")
    last = copy_numbers(last, leaf, "__piece").withColumn("__times", F.col("__full") + F.when(F.col("__copy") < F.col("__fit"), 1).otherwise(0))
    both = sure.filter(F.col("__stop").isNull() | (F.col("__h") != F.col("__stop"))).select(*docs.columns, "__times")
    both = both.unionByName(last.select(*docs.columns, "__times"))
    steps = F.when(F.col("__times") > 0, F.sequence(F.lit(0), F.col("__times").cast("int") - 1))
    return both.withColumn("epoch", F.explode(steps)).drop("__times")
