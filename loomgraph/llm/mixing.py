"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / size of the source. The source's
documents stand in a fixed order, the expected copies are prefix-summed, one offset per source is added, and a
document is emitted once for each integer boundary that its part of the sum crosses. Rows are ordered by size class,
so that copies spread evenly over short and long documents and the words taken stay within about one longest document
of the target.

Prefix sums are two-level: a source is split into (size class, salt) blocks, block totals are summed over the blocks
of a source and documents within their block, so a source with a third of all rows is never one task's work.

Defined results: null text has size 0; null source is a source of its own, last in the order of sources; a source
without words has target 0 and takes nothing; equal rows are different documents and each gets its own place; very long
texts are counted whole; an empty table gives an empty result; extra columns are ignored by mix() and kept by
mix_documents() whatever their names. The order of sources and the levels of their targets are windows over one row for
each source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
SALTS = 64
#: Runs of characters that count as a word.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = ("source", "size_class", "salt")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target from (source, source_size, n_docs): one row per source.

    Targets are min(most * size, level * weight): sorted by most * size / weight, the capped sources are a prefix, and
    running sums give each prefix's level. Works on aggregated sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))).withColumn(
        "cap", F.lit(most) * F.col("source_size")
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(fill.rowsBetween(0, Window.unboundedFollowing))
    # A source is capped when even the level that it would get as the first open one is above its cap.
    leveled = ranked.withColumn("own_level", level).withColumn("capped", F.col("own_level") * F.col("weight") >= F.col("cap"))
    shared = leveled.withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("own_level").alias("v")))).over(everything)["v"])
    target = F.when(F.col("capped") | F.col("open_level").isNull(), F.col("cap")).otherwise(F.col("open_level") * F.col("weight"))
    return shared.select("source", "source_size", "n_docs", F.least(target, F.col("cap")).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), *more).withColumns(
        {"size_class": F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")}
    )


def _place(sized: DataFrame, weights: tuple, share: float, most: float, seed: int) -> DataFrame:
    """sized with source_size, target and copies."""
    blocks = sized.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("block_docs"), F.sum("size").alias("block_size"))
    sources = blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"), F.sum("block_docs").alias("n_docs"))
    wanted = targets(sources, weights, share, most)
    before = Window.partitionBy("source").orderBy(F.col("size_class").desc(), "salt")
    placed = blocks.withColumn("docs_before", F.sum("block_docs").over(before) - F.col("block_docs"))
    plan = placed.join(wanted.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(
        *[F.col(c).alias(f"b_{c}") for c in BLOCK], "docs_before", "source_size", "target"
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size_class") == F.col("b_size_class")) & (F.col("salt") == F.col("b_salt")))
    nth = F.col("docs_before") + F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.col("size").desc(), "doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Documents of size 0 take a place in the order too; they add no words.
    crossed = F.floor(F.col("nth") * F.col("rate") + F.col("start")) - F.floor((F.col("nth") - 1) * F.col("rate") + F.col("start"))
    return joined.withColumns({"nth": nth, "rate": rate, "start": offset}).withColumn("copies", crossed.cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs. Reruns agree."""
    sized = materialize(_sized(docs), "mixing")
    return _place(sized, weights, share, most, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 9, copy_column: str | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, with all its columns.

    copy_column: the name of one more column that numbers the copies of a row from 1.
    """
    sized = _sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"))
    taken = _place(sized, weights, share, most, seed).where("copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns], *([F.col("mix_copy").alias(copy_column)] if copy_column else []))
