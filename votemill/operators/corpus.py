"""The joined corpus of each group of texts, without ever holding one whole.

Every text gets its place in the corpus (texts in order, a blank between them)
from a running total of lengths; the corpus is then made in chunks of bounded
size from the texts, or parts of texts, that reach into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from votemill.runtime import running_total

#: Stands between parts of a chunk that are not neighbours in the corpus.
GAP = "\u0000"


def placed(texts: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """Adds ``start``: where each text begins in its group's corpus, from 0.  Null texts are no part of it.

    Only lengths are ordered and summed; texts travel once, to the place of
    their key.  Those of one key follow each other in the order of the texts.
    """
    held = texts.where(F.col(text).isNotNull()).withColumn("_key", F.struct(group, *order)).withColumn("_step", F.length(text).cast("long") + 1)
    steps = held.groupBy(group, *order).agg(F.sum("_step").alias("_step"))
    starts = running_total(steps, group, order, "_step", "_start").select(F.struct(group, *order).alias("_key"), "_start")
    before = W.partitionBy("_key").orderBy(text).rowsBetween(W.unboundedPreceding, -1)
    return (held.join(starts, "_key").withColumn("start", F.col("_start") + F.coalesce(F.sum("_step").over(before), F.lit(0)))
            .drop("_key", "_start", "_step"))


def chunks(pieces: DataFrame, group: str, size: Column, overlap: Column) -> DataFrame:
    """(group, chunk, text): what pieces ``(group, pos, piece)`` put into every stretch of ``size`` characters and the ``overlap`` ones after it.

    At most size + overlap characters meet in a row, whatever the group holds.
    """
    end = F.col("pos") + F.length("piece")
    reach = pieces.where(F.length("piece") > 0).select("*", size.cast("long").alias("_size"), overlap.cast("long").alias("_overlap"))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("_overlap")) / F.col("_size")))
    met = reach.select("*", F.explode(F.sequence(first, F.floor((end - 1) / F.col("_size")))).alias("chunk"))
    low = F.greatest(F.col("pos"), F.col("chunk") * F.col("_size"))
    high = F.least(end, (F.col("chunk") + 1) * F.col("_size") + F.col("_overlap"))
    part = F.substring("piece", (low - F.col("pos") + 1).cast("int"), (high - low).cast("int"))
    cut = met.select(group, "chunk", low.alias("pos"), part.alias("part")).where(F.length("part") > 0)
    parts = F.col("parts")

    def joined(p: Column, i: Column) -> Column:
        before = parts[i - 1]
        apart = (i > 0) & (p["pos"] != before["pos"] + F.length(before["part"]))
        return F.when(F.coalesce(apart, F.lit(False)), F.concat(F.lit(GAP), p["part"])).otherwise(p["part"])

    gathered = cut.groupBy(group, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return gathered.select(group, "chunk", F.array_join(F.transform("parts", joined), "").alias("text"))


def _with_blank(starts: DataFrame, text: Column) -> Column:
    return F.when(F.col("start") > 0, F.concat(F.lit(" "), text)).otherwise(text)


def joined(texts: DataFrame, group: str, order: list[str], text: str, part_chars: int) -> DataFrame:
    """(group, part, text): the corpus in numbered parts of ``part_chars`` characters, the last one shorter."""
    at = placed(texts, group, order, text)
    pos = F.when(F.col("start") > 0, F.col("start") - 1).otherwise(F.lit(0).cast("long"))
    pieces = at.select(group, pos.alias("pos"), _with_blank(at, F.col(text)).alias("piece"))
    return chunks(pieces, group, F.lit(part_chars), F.lit(0)).withColumnRenamed("chunk", "part")


def across_seams(quotes: DataFrame, texts: DataFrame, group: str, order: list[str], text: str, quote: str) -> DataFrame:
    """The (group, quote) that stand in the corpus of their group over the seam of two texts or more.

    Of a long text only its two ends, as long as the group's longest quote,
    take part; windows of a few such lengths are searched.
    """
    asked = quotes.groupBy(group).agg(F.max(F.length(quote)).cast("long").alias("_reach"), F.collect_set(quote).alias("_quotes"))
    at = placed(texts.select(group, *order, text).join(asked.select(F.col(group)), group, "left_semi"), group, order, text)
    at = at.join(asked.select(group, "_reach"), group)
    blank, length, reach = (F.col("start") > 0).cast("int"), F.length(text), F.col("_reach").cast("int")
    whole = _with_blank(at, F.col(text))
    ends = F.array(F.struct((F.col("start") - blank).alias("pos"), F.substring(whole, F.lit(1), reach + 1).alias("piece")),
                   F.struct((F.col("start") + length - reach).alias("pos"), F.substring(F.col(text), length - reach + 1, reach).alias("piece")))
    pieces = F.when(length <= 2 * reach, F.array(F.struct((F.col("start") - blank).alias("pos"), whole.alias("piece")))).otherwise(ends)
    near = at.select(group, "_reach", F.inline(pieces))
    windows = chunks(near, group, 4 * F.col("_reach"), F.col("_reach"))
    held = F.filter("_quotes", lambda q: F.contains(F.col("text"), q))
    return windows.join(asked.select(group, "_quotes"), group).select(group, F.explode(held).alias(quote)).distinct()
