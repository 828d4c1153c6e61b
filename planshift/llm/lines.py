"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the pages of the host that contain it make up more than a given share of all
pages of the host; every finding of such a line is dropped there. Lines are counted once per page, by two hashes
(96 bits) of their text without outer white space, and the counts are combined in the map tasks, so a line that is on
every page of the largest host costs one row per task. Per host at most (mean lines per page / ratio) lines can be
boilerplate, so they fit in one array per host, which meets the pages in one join; texts are not shuffled where the
arrays of all hosts are few enough to be broadcast, and meet a salted copy of them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import BROADCAST_BYTES, key_text, stored

WHITE = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """96 bits that stand for a line: outer white space does not count."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def has_words(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(WHITE))) > 0


def boilerplate_lines(
    docs: DataFrame, text: str, host: str, ratio: float, least_pages: int
) -> DataFrame:
    """Per host (as ``__host``) the keys of lines on more than ``ratio`` of its pages and on ``least_pages`` at least."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), has_words), line_key))
    none = F.array().cast("array<struct<a:bigint,b:int>>")
    pages = docs.select(key_text(host).alias("__host"), F.coalesce(lines, none).alias("__lines"))
    # the empty key counts the pages themselves, so one aggregation gives both numbers
    counted = (
        pages.select("__host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:int>")), "__lines")).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__pages"))
    )
    counted = stored(counted.filter(F.col("__line").isNull() | (F.col("__pages") >= least_pages)), "line-pages")
    totals = counted.filter(F.col("__line").isNull()).select("__host", F.col("__pages").alias("__total"))
    return (
        counted.filter(F.col("__line").isNotNull())
        .join(totals, "__host")
        .filter(F.col("__pages") > ratio * F.col("__total"))
        .groupBy("__host")
        .agg(F.collect_list("__line").alias("__drop"))
    )


def drop_boilerplate(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    ratio: float = 0.2,
    least_pages: int = 3,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of its hosts taken out of ``text``; all other columns stay as they are.

    Lines are split at \\n; blank lines are neither counted nor dropped. A text without boilerplate is unchanged, a
    null text stays null, a text of boilerplate alone becomes empty. Null hosts are one host. Lines on fewer than
    ``least_pages`` pages of a host stay, whatever their share, so that small hosts keep their content. With ``removed``
    the number of dropped lines is added under that name (replacing a column of that name). Columns named ``__...`` are
    reserved.
    """
    flagged = stored(boilerplate_lines(docs, text, host, ratio, least_pages), "boilerplate")
    size = flagged.agg(F.sum(F.size("__drop") * 24 + F.octet_length("__host") + 64)).first()[0] or 0
    keyed = docs.withColumn("__host", key_text(host))
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(flagged), "__host", "left")
    else:
        # a host with most pages is spread over as many keys as there are shuffle partitions
        salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = flagged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = keyed.withColumn("__salt", F.floor(F.rand(1) * salts).cast("int"))
        joined = salted.join(copies, ["__host", "__salt"], "left").drop("__salt")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: ~(has_words(x) & F.array_contains(F.col("__drop"), line_key(x))))
    known = F.col("__drop").isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn("__kept", F.when(known, kept))
    if removed:
        count = F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0))
        out = out.withColumn(removed, F.when(known, count).otherwise(0).cast("long"))
    changed = known & (F.size("__kept") < F.size(lines))
    return out.withColumn(text, F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col(text))).drop(
        "__host", "__drop", "__kept"
    )
