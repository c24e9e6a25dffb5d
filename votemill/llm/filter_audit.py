"""How filters of documents act on each other, from relations of failing ids.

Each filter has a table of the ids that fail it.  What a filter removes behind a
prefix of others are its failing ids left-anti joined with the tables of the
prefix; what is redundant there are its other failing ids; labels lost are those
removed that left-semi join the labelled ids.  A filter's removals depend on the
set of filters before it, not on their order, and rows that fail nothing are
never removed, so only failing ids travel: each doubles at every table, one copy
for the prefixes without that filter, which stays, and one for those with it,
which the anti-join has to pass.  All tables are joined on the id, so the ids
are dealt out once.  Survivors of a prefix are the rows of the part less what
its steps removed (``survivors`` gives them as rows).

Rows are identified by a number of their own, so repeated rows and rows without
doc_id each count.  A null or empty text has no words and code points and equals
every other such text; a row without doc_id is no smaller row's copy and no
row's original, and has no labels.  A doc_id is labelled if any of its rows in
the labels says so.  Texts are read whole in one pass.  A null part counts as
the empty string.  An empty table has no parts and gives no rows.  Only the
columns named are read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from votemill import runtime
from votemill.llm import caches, textblocks as tb

#: Least words; least share of distinct words, most share of capitals (percent); characters not allowed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
MEASURES = ("removed", "good_lost", "toxic_lost")


def _text_flags(column: pa.Array) -> list[pa.Array]:
    """Filters A to D on whole texts: true where a text fails."""
    caches.enter("audit")
    mark = np.zeros(256, bool)
    mark[list(MARKS)] = True
    out: list[list[np.ndarray]] = [[], [], [], []]
    for _, buf, off in tb.text_blocks(column):
        n = len(off) - 1
        start, end, row = tb.words(buf, off)
        words = np.bincount(row, minlength=n)
        _, own = tb.distinct_per_row(tb.span_hash(tb.prefix_sums(buf), start, end), row)
        distinct = np.bincount(own, minlength=n)

        def per_text(hit: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(hit)])
            return upto[off[1:]] - upto[off[:-1]]

        points, capitals, marks = per_text(buf & 0xC0 != 0x80), per_text((buf >= 65) & (buf <= 90)), per_text(mark[buf])
        for flags, failed in zip(out, (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, marks > 0)):
            flags.append(failed)
    return [pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)) for flags in out]


def text_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Written rows (id, part, good, toxic, A .. E) of every document: its number, part, labels and the filters it fails.

    E fails where a smaller key has the same text.  Only texts that several
    rows have are looked at again, by their SHA-256.
    """
    flagged = tb.map_texts(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").cast("string").alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
                           .withColumn("digest", F.unhex(F.sha2("text", 256))), "text", ["key", "part", "digest"], _text_flags, [(f, T.BooleanType()) for f in "ABCD"])
    rows = runtime.materialize(flagged.select("row.key", F.coalesce("row.part", F.lit("")).alias("part"), "row.digest", *"ABCD", F.monotonically_increasing_id().alias("id")), "filters")
    shared = rows.groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    copies = rows.join(shared, F.expr("digest = same and key > least"), "left_semi").select("id")
    marked = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.join(marked, "key", "left").select("id", "part", *"ABCD", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return runtime.materialize(known.join(copies.withColumn("E", F.lit(True)), "id", "left").withColumn("E", F.coalesce("E", F.lit(False))), "filters")


def failing_ids(rows: DataFrame, filters: Mapping[str, Column]) -> dict[str, DataFrame]:
    """One written table of ids for each filter; ``filters`` says which rows of (id, ...) fail."""
    return {name: runtime.materialize(rows.where(fails).select("id"), f"fails-{name}") for name, fails in filters.items()}


def survivors(rows: DataFrame, tables: Mapping[str, DataFrame], prefix: str | list[str]) -> DataFrame:
    """The rows that none of the filters of a prefix removes."""
    for name in prefix:
        rows = rows.join(tables[name], "id", "left_anti")
    return rows


def removals(rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(part, filter, before, removed, good_lost, toxic_lost) of every filter behind every set of others.

    ``filter`` numbers the tables, ``before`` has a bit for each of them that
    comes earlier.  ``rows`` has id, part, good and toxic.  Combinations that
    remove nothing have no row.
    """
    failing = None
    for number, table in enumerate(tables.values()):
        own = rows.select("id", "part", "good", "toxic").join(table, "id", "left_semi").withColumn("filter", F.lit(number))
        failing = own if failing is None else failing.unionByName(own)
    moved = failing.withColumn("before", F.lit(0))
    for number, table in enumerate(tables.values()):
        both = F.when(F.col("filter") == number, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        moved = moved.select("*", F.explode(both).alias("behind"))
        gone = table.withColumnRenamed("id", "gone")
        moved = moved.join(gone, (moved.id == gone.gone) & moved.behind, "left_anti")
        moved = moved.withColumn("before", F.col("before").bitwiseOR(F.when(F.col("behind"), 1 << number).otherwise(0))).drop("behind")
    counts = [F.count(F.lit(1)), F.count_if("good"), F.count_if("toxic")]
    return moved.groupBy("part", "filter", "before").agg(*[c.alias(m) for c, m in zip(counts, MEASURES)])


def audit(rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per part, order of all filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters are named by single letters; there are factorially many
    orders, so this is for a handful of filters.  The counts of a part are one
    row, and the orders are made from it without a join.
    """
    names, n = list(tables), len(tables)
    counted = removals(rows, tables)
    code = F.col("filter") * F.lit(1 << n) + F.col("before")
    # at most n 2^(n-1) entries in a part
    cells = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(code.alias("code"), F.struct(*MEASURES).alias("counts")))).alias("cells"))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    parts = totals.join(cells, "part", "left")

    def count(which: Column | int, before: Column | int, measure: str = "removed") -> Column:
        at = (F.lit(which) if isinstance(which, int) else which) * (1 << n) + (F.lit(before) if isinstance(before, int) else before)
        return F.coalesce(F.element_at("cells", at)[measure], F.lit(0).cast("long"))

    everything = (1 << n) - 1
    sets = {k: [s for s in range(1 << n) if not s >> k & 1] for k in range(n)}
    weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(everything)}
    own = [F.struct(count(k, 0).alias("fails"), count(k, everything & ~(1 << k)).alias("unique_fails"),
                    sum((count(k, s) * weight[s] for s in sets[k][1:]), count(k, 0) * weight[0]).alias("shapley")) for k in range(n)]
    orders = [",".join(map(str, p)) for p in permutations(range(n))]
    stepped = (parts.select("*", F.array(*own).alias("own")).select("*", F.explode(F.lit(orders)).alias("order")).withColumn("order", F.split("order", ",").cast("array<int>"))
               .select("*", F.posexplode("order").alias("at", "filter")))

    def before(at: Column) -> Column:
        return F.aggregate(F.slice("order", 1, at), F.lit(0), lambda held, k: held + F.call_function("shiftleft", F.lit(1), k))

    gone = F.aggregate(F.sequence(F.lit(0), F.col("at")), F.lit(0).cast("long"), lambda total, i: total + count(F.col("order")[i], before(i)))
    placed = stepped.withColumn("before", before(F.col("at")))
    removed, mine = count(F.col("filter"), F.col("before")), F.col("own")[F.col("filter")]
    letters = F.array(*[F.lit(x) for x in names])
    return placed.select("part", F.array_join(F.transform("order", lambda k: letters[k]), "").alias("filter_order"), (F.col("at") + 1).alias("step"),
                         (F.col("rows") - gone).alias("kept"), removed.alias("removed"), (mine["fails"] - removed).alias("redundant"), mine["unique_fails"].alias("unique_fails"),
                         count(F.col("filter"), F.col("before"), "good_lost").alias("good_lost"), count(F.col("filter"), F.col("before"), "toxic_lost").alias("toxic_lost"), mine["shapley"].alias("shapley"))
