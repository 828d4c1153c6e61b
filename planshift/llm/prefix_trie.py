"""Conversation prefix trie by whole-sequence collapse.

Conversations are rebuilt (a shared head from another conversation, then their own turns) and identical ones are grouped
into one weighted sequence that is named by its smallest conversation; the ids that end there are its end list. Only one
copy of every sequence goes on. Its prefixes are the nodes; a sequence that is a proper prefix of another one is dropped
by an anti-join, so those that stay are the leaves; node counts are sums over the weighted prefixes.

Sums over subtrees need no walk of the tree. A node's subtree is made of the rest of every sequence through it. Counted
by weight, the rest of a sequence is its total less what lies before the node. Counted once a node, every node is owned
by its smallest sequence; what a sequence owns is an end of its path, so the owned part of its rest is the smaller of
the rest and of all that it owns.

A prefix is told apart by its depth and two 64-bit numbers, the exclusive or of hashes of its turns at their places.
These can be put together from parts, so a conversation of any length is spread: its turns are ranked in pieces of
ranges and its prefixes run in blocks of ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planshift.llm.shared import stored
from planshift.operators.joins import hot_values, lookup_join

# Turns of a sequence that one window runs over, and conversation ids of an end list that one row holds.
BLOCK = 1024
END_IDS = 4096
NODE = ["__d", "__p1", "__p2"]


@dataclass(frozen=True)
class PrefixTrie:
    """``nodes``: one row per node. ``ends``: the ids that end at a node, ascending, in rows of bounded length."""

    nodes: DataFrame
    ends: DataFrame


def _positions(turns: DataFrame) -> DataFrame:
    """Adds ``__pos``, the place of a turn in its conversation from 1.

    Turns lie in ranges of (conversation, turn); ranks run inside the piece of a conversation that lies in one range and
    continue over the counts of its earlier pieces.
    """
    ranged = turns.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange("__c", "__turn", "__t", "__u")
    ranged = stored(ranged.withColumn("__piece", F.spark_partition_id()), "trie-turns")
    piece = ["__c", "__piece"]
    inside = Window.partitionBy(*piece).orderBy(F.col("__turn").asc_nulls_first(), "__t", "__u")
    earlier = Window.partitionBy("__c").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*piece).agg(F.count(F.lit(1)).alias("__n"))
    bases = counts.select(*piece, F.sum("__n").over(earlier).alias("__base")).filter(F.col("__base").isNotNull())
    placed = ranged.withColumn("__in", F.row_number().over(inside)).join(bases, piece, "left")
    return placed.select("__c", "__t", "__chars", (F.col("__in") + F.coalesce("__base", F.lit(0))).alias("__pos"))


def _rebuilt(turns: DataFrame, most_head: int, every: int) -> tuple[DataFrame, DataFrame]:
    """All conversations (``__c``), and the rows of the rebuilt ones (``__c``, ``__pos``, ``__t``, ``__chars``)."""
    c = F.col("__c")
    taken = (F.crc32(c.cast("string")) % (most_head + 1)).cast("int")
    heads = (
        turns.filter((c % every == 0) & (F.col("__pos") <= most_head))
        .groupBy(c.alias("__base"))
        .agg(F.sort_array(F.collect_list(F.struct("__pos", "__t", "__chars"))).alias("__head"))
    )
    convs = stored(
        turns.select("__c").distinct().withColumn("__base", c - c % every).join(heads, "__base", "left")
        .select("__c", F.slice(F.coalesce("__head", F.array()), 1, taken).alias("__head")),
        "trie-conversations",
    )
    first = convs.select("__c", F.inline("__head")).select("__c", F.col("__pos").cast("long").alias("__pos"), "__t", "__chars")
    own = turns.filter(F.col("__pos") > taken).join(convs.select("__c", F.size("__head").alias("__k")), "__c")
    own = own.select("__c", (F.col("__pos") - taken + F.col("__k")).cast("long").alias("__pos"), "__t", "__chars")
    return convs.select("__c"), stored(first.union(own), "trie-rebuilt")


def _prefixes(rows: DataFrame) -> DataFrame:
    """Adds the node of every turn (``NODE``), its parent (``__q1``, ``__q2``) and the characters before the turn."""
    block = ["__c", "__block"]
    rows = rows.withColumn("__block", F.floor((F.col("__pos") - 1) / BLOCK))
    run = Window.partitionBy(*block).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__c").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*block).agg(
        F.bit_xor("__x1").alias("__s1"), F.bit_xor("__x2").alias("__s2"), F.sum("__chars").alias("__s")
    )
    bases = sums.select(
        *block, F.bit_xor("__s1").over(earlier).alias("__b1"), F.bit_xor("__s2").over(earlier).alias("__b2"),
        F.sum("__s").over(earlier).alias("__b"),
    ).filter("__block > 0")
    inside = rows.withColumns(
        {"__r1": F.bit_xor("__x1").over(run), "__r2": F.bit_xor("__x2").over(run), "__r": F.sum("__chars").over(run)}
    )
    joined = inside.join(bases, block, "left")
    nought = F.lit(0).cast("long")
    p1 = F.col("__r1").bitwiseXOR(F.coalesce("__b1", nought))
    p2 = F.col("__r2").bitwiseXOR(F.coalesce("__b2", nought))
    return joined.select(
        "__c", F.col("__pos").alias("__d"), p1.alias("__p1"), p2.alias("__p2"),
        p1.bitwiseXOR(F.col("__x1")).alias("__q1"), p2.bitwiseXOR(F.col("__x2")).alias("__q2"), "__chars",
        (F.col("__r") + F.coalesce("__b", nought) - F.col("__chars")).alias("__before"),
        "__weight", "__total", "__len",
    )


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    most_head: int = 5, every: int = 100,
) -> PrefixTrie:
    """The trie of the rebuilt conversations; of ``conversations`` only the four columns are read.

    Conversation c becomes the first h turns of conversation c - c % ``every`` (all if fewer, none if absent) and its own
    turns after its first h; h is crc32 of the decimal c modulo ``most_head`` + 1.

    ``nodes``: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``; (conv_id, depth) names a node. ``ends``: ``conv_id``, ``depth``, ``block`` and
    ``ids``, at most ``END_IDS`` a row, ascending within and over the blocks.

    Turns are ordered by ``turn``, null first; equal turns by the digest of role and text, so repeated rows are turns of
    their own and their order cannot matter. Null roles and texts are empty. Rows without a conversation id belong to no
    conversation and are left out. A conversation that ends up without turns ends at the root. An empty table has no
    nodes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    turns = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("__c"), F.col(turn).alias("__turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, body)).alias("__t"),
        F.length(body).cast("long").alias("__chars"),
    )
    convs, rebuilt = _rebuilt(_positions(turns), most_head, every)
    nought = F.lit(0).cast("long")

    def spot(first: Column, last: Column) -> Column:
        return F.xxhash64(first, F.col("__pos"), last)

    rebuilt = rebuilt.withColumns({"__x1": spot(F.col("__t"), F.lit(1)), "__x2": spot(F.lit(2), F.col("__t"))})
    # whole sequences, told apart by their last prefix
    whole = rebuilt.groupBy("__c").agg(
        F.bit_xor("__x1").alias("__p1"), F.bit_xor("__x2").alias("__p2"), F.count(F.lit(1)).alias("__d"),
        F.sum("__chars").alias("__total"),
    )
    whole = convs.join(whole, "__c", "left").na.fill(0, ["__p1", "__p2", "__d", "__total"])
    whole = stored(whole.select("__c", *NODE, "__total"), "trie-members")
    sequences = whole.groupBy(*NODE).agg(
        F.min("__c").alias("__c"), F.count(F.lit(1)).alias("__weight"), F.first("__total").alias("__total")
    )
    sequences = stored(sequences, "trie-sequences")
    kept = rebuilt.join(sequences.select("__c", "__weight", "__total", F.col("__d").alias("__len")), "__c")
    roots = sequences.select(
        "__c", nought.alias("__d"), nought.alias("__p1"), nought.alias("__p2"), F.lit(None).cast("long").alias("__q1"),
        F.lit(None).cast("long").alias("__q2"), nought.alias("__chars"), nought.alias("__before"), "__weight", "__total",
        F.col("__d").alias("__len"),
    )
    prefixes = stored(_prefixes(kept).unionByName(roots), "trie-prefixes")
    proper = prefixes.filter("__d < __len").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("__c", F.lit(1).cast("long").alias("__leaf"))
    # a node is owned by its smallest sequence
    owners = prefixes.groupBy(*NODE).agg(F.min("__c").alias("__c"), F.max("__chars").alias("__chars"))
    owned = owners.groupBy("__c").agg(F.sum("__chars").alias("__own"))
    facts = sequences.select("__c").join(owned, "__c", "left").join(leaves, "__c", "left").na.fill(0, ["__own", "__leaf"])
    rest = F.col("__total") - F.col("__before")
    nodes = stored(
        prefixes.join(facts, "__c").groupBy(*NODE).agg(
            F.min("__c").alias("conv_id"), F.min("__q1").alias("__q1"), F.min("__q2").alias("__q2"),
            F.sum("__weight").alias("n_convs"), F.sum("__leaf").alias("n_leaves"),
            F.sum(F.col("__weight") * rest - F.least(rest, F.col("__own"))).alias("saved_tokens"),
        ),
        "trie-nodes",
    )
    return PrefixTrie(_linked(nodes), _ends(whole, nodes))


def _linked(nodes: DataFrame) -> DataFrame:
    """Adds children and parents; parents of many children are looked up over several tasks."""
    above = [(F.col("__d") - 1).alias("__d"), F.col("__q1").alias("__p1"), F.col("__q2").alias("__p2")]
    below = nodes.filter("__d > 0")
    children = below.select(*above).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    facts = nodes.drop("__q1", "__q2").join(children, NODE, "left").na.fill(0, ["n_children"])
    links = below.select(F.col("conv_id").alias("__child"), *above)
    names = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    parents = lookup_join(links, names, NODE, "inner", "__p1", hot_values(links, "__p1")["__p1"])
    parents = parents.select(F.col("__child").alias("conv_id"), (F.col("__d") + 1).alias("__d"), "parent_conv_id")
    return facts.join(parents, ["conv_id", "__d"], "left").select(
        "conv_id", F.col("__d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    )


def _ends(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members that end at each node, in blocks of neighbouring ids, so that no row holds a long list."""
    blocks = whole.groupBy(*NODE, F.floor(F.col("__c") / END_IDS).alias("block")).agg(
        F.sort_array(F.collect_list("__c")).alias("ids")
    )
    return blocks.join(nodes.select(*NODE, "conv_id"), NODE).select("conv_id", F.col("__d").alias("depth"), "block", "ids")


def ends_sha256(ends: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` and the SHA-256 of the comma-joined end ids; a list of any length is read block by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            found = []
            for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv, depth):
                    if now is not None:
                        found.append((*now, digest.hexdigest()))
                    now, digest = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows(found)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "ends_sha256"])

    texts = ends.select("conv_id", "depth", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return ordered.drop("block").mapInArrow(work, "conv_id long, depth long, ends_sha256 string")
