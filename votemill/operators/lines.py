"""Group lines, deviations from them, and cohesion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.runtime import global_rank, materialize, ship


def substantive_votes(vote: DataFrame) -> DataFrame:
    return vote.where(F.col("is_procedural") == 0)


def party_line(vote_record: DataFrame, vote: DataFrame) -> DataFrame:
    """Majority of yes/no per (vote, group); equal counts give a tie, no yes/no gives no row."""
    cast = (vote_record.where(F.col("party").isNotNull() & S.is_substantive(F.col("vote_value")))
            .join(substantive_votes(vote).select("vote_id"), "vote_id", "left_semi"))
    yes = F.count_if(F.col("vote_value") == C.YES)
    no = F.count_if(F.col("vote_value") == C.NO)
    return (cast.groupBy("vote_id", "party").agg(yes.alias("n_yes"), no.alias("n_no"))
            .select("vote_id", "party",
                    F.when(F.col("n_yes") == F.col("n_no"), C.LINE_TIE)
                    .when(F.col("n_yes") > F.col("n_no"), C.YES).otherwise(C.NO).alias("line")))


def party_deviation(vote_record: DataFrame, vote: DataFrame, line: DataFrame | None = None) -> DataFrame:
    """Class of every member vote against the line of the member's group."""
    line = party_line(vote_record, vote) if line is None else line
    rec = (vote_record.where(F.col("person_id").isNotNull() & F.col("party").isNotNull())
           .join(substantive_votes(vote).select("vote_id"), "vote_id", "left_semi"))
    value, its = F.col("vote_value"), F.coalesce(F.col("line"), F.lit(C.LINE_UNDEFINED))
    cls = (F.when(value == C.ABSENT, C.CLASS_ABSENT)
           .when(value == C.BLANK, C.INELIGIBLE)
           .when(its.isin(C.LINE_TIE, C.LINE_UNDEFINED), C.INELIGIBLE)
           .when(value == its, C.FOLLOWS)
           .otherwise(C.DEVIATES))
    return (rec.join(line, ["vote_id", "party"], "left")
            .select("person_id", "vote_id", "party", value.alias("member_value"),
                    its.alias("party_line"), cls.alias("classification")))


def deviation_counts(deviation: DataFrame, key: str = "person_id") -> DataFrame:
    """Followed and deviating votes per key."""
    return deviation.groupBy(key).agg(
        F.count_if(F.col("classification") == C.FOLLOWS).alias("follows"),
        F.count_if(F.col("classification") == C.DEVIATES).alias("deviates"))


def party_cohesion(deviation: DataFrame, min_eligible: int = 1000) -> DataFrame:
    """Share of deviating votes per group at the time of the vote."""
    d = (deviation.where(F.col("classification").isin(C.FOLLOWS, C.DEVIATES) & F.col("party").isNotNull())
         .groupBy("party").agg(F.count(F.lit(1)).alias("eligible"),
                               F.count_if(F.col("classification") == C.DEVIATES).alias("deviations"))
         .where(F.col("eligible") >= min_eligible))
    return d.withColumn("pct", F.round(100.0 * F.col("deviations") / F.col("eligible"), 2))


def party_covote(deviation: DataFrame, parties=C.MATRIX_PARTIES, min_votes: int = 200) -> DataFrame:
    """Share of votes where two groups had the same line, for each pair of the given groups.

    The lines of a vote become one row with a column per group, so a pair is
    one expression over that row; no self join and no pairs of rows are built.
    Both orders of a pair are returned.
    """
    lines = (deviation.where(S.is_substantive(F.col("party_line")) & F.col("party").isin(*parties))
             .groupBy("vote_id").pivot("party", list(parties)).agg(F.min("party_line")))
    pairs = [(a, b) for i, a in enumerate(parties) for b in parties[i + 1:]]

    def col(p):
        return F.col(f"`{p}`")

    totals = lines.agg(
        *[F.count(col(p)).alias(f"n{i}") for i, p in enumerate(parties)],
        *[F.count_if(col(a).isNotNull() & col(b).isNotNull()).alias(f"t{k}") for k, (a, b) in enumerate(pairs)],
        *[F.count_if(col(a) == col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    pos = {p: i for i, p in enumerate(parties)}
    cells = [F.struct(F.lit(x).alias("party_a"), F.lit(y).alias("party_b"), F.col(f"s{k}").alias("agree"),
                      F.col(f"t{k}").alias("total"), F.col(f"n{pos[a]}").alias("na"), F.col(f"n{pos[b]}").alias("nb"))
             for k, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return (totals.select(F.inline(F.array(*cells)))
            .where((F.col("na") >= min_votes) & (F.col("nb") >= min_votes))
            .select("party_a", "party_b", "agree", "total",
                    F.when(F.col("total") > 0, F.bround(100 * F.col("agree") / F.col("total"), 0)).alias("pct")))


def member_party_agreement(vote_record: DataFrame, line: DataFrame, min_total: int = 50) -> DataFrame:
    """How often each member voted as each group's line: one row per (member, group)."""
    sides = line.where(S.is_substantive(F.col("line"))).select("vote_id", "party", "line")
    own = vote_record.where(S.is_substantive(F.col("vote_value"))).select("vote_id", "person_id", "vote_value")
    return (own.join(sides, "vote_id")
            .groupBy("person_id", "party")
            .agg(F.count_if(F.col("vote_value") == F.col("line")).alias("agree"),
                 F.count(F.lit(1)).alias("total"))
            .where(F.col("total") >= min_total)
            .withColumn("pct", F.round(100.0 * F.col("agree") / F.col("total"), 0)))


def pair_agreement(vote_record: DataFrame, pairs: DataFrame) -> DataFrame:
    """Agreement of the requested pairs ``(a, b)`` over votes both took a side in."""
    own = vote_record.where(S.is_substantive(F.col("vote_value")))
    va = own.select(F.col("person_id").alias("a"), "vote_id", F.col("vote_value").alias("va"))
    vb = own.select(F.col("person_id").alias("b"), "vote_id", F.col("vote_value").alias("vb"))
    return (pairs.select("a", "b").distinct().join(va, "a").join(vb, ["b", "vote_id"])
            .groupBy("a", "b").agg(F.count_if(F.col("va") == F.col("vb")).alias("agree"),
                                   F.count(F.lit(1)).alias("total"))
            .withColumn("pct", F.bround(100 * F.col("agree") / F.col("total"), 0)))


#: Votes that a dense product takes at once are ``WORD * WORDS``.
WORD, WORDS = 64, 16
#: Cells, and votes, in a lot that is dealt out as one row for each two tiles.
LOT_CELLS, LOT_VOTES = 1 << 20, 1 << 16


def _lots(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, lengths) of the lists of some rows, in lots of bounded size (of one row, if that is longer)."""
    for batch in batches:
        lists = batch.column(0)
        lengths, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        ends, at, first = np.cumsum(lengths, dtype=np.int64), 0, 0
        while at < len(lengths):
            to = min(max(at + 1, int(np.searchsorted(ends, first + LOT_CELLS, side="right"))), at + LOT_VOTES)
            last = int(ends[min(to, len(lengths)) - 1])
            yield values[first:last], lengths[at:to]
            at, first = to, last


def _count_pairs(va: np.ndarray, a: np.ndarray, vb: np.ndarray, b: np.ndarray, total: np.ndarray, agree: np.ndarray) -> None:
    """Adds what two tiles of members said in the same votes; cells are sorted by vote ``va`` and ``vb`` and hold twice the member's place, and one more for a yes."""
    votes = max(int(va[-1]), int(vb[-1])) + 1
    per = np.bincount(vb, minlength=votes)
    meets = per[va]
    ends = np.cumsum(meets, dtype=np.int64)
    if ends[-1] * 128 > np.count_nonzero(per) * total.size:  # full enough for dense products
        for low in range(0, votes, WORD * WORDS):
            x, y = (_dense(v, c, low, n) for v, c, n in ((va, a, total.shape[0]), (vb, b, total.shape[1])))
            both, signed = (x[0] + x[1]).T @ (y[0] + y[1]), (x[1] - x[0]).T @ (y[1] - y[0])
            total += both.astype(np.int64)
            agree += ((both + signed) / 2).astype(np.int64)
        return
    first = np.cumsum(per) - per
    at = 0
    while at < len(va):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT_CELLS, side="right")))
        m = meets[at:to]
        left = np.repeat(np.arange(at, to), m)
        right = np.repeat(first[va[at:to]] - (np.cumsum(m) - m), m) + np.arange(len(left))
        place, same = (a[left] >> 1) * total.shape[1] + (b[right] >> 1), ((a[left] ^ b[right]) & 1) == 0
        np.add.at(total.reshape(-1), place, np.int64(1))
        np.add.at(agree.reshape(-1), place[same], np.int64(1))
        at = to


def _dense(vote: np.ndarray, cells: np.ndarray, low: int, n: int) -> np.ndarray:
    """Noes and yeses of the votes from ``low`` on, as 0 and 1."""
    part = slice(*np.searchsorted(vote, [low, low + WORD * WORDS]))
    x = np.zeros((2, WORD * WORDS, n), np.float32)
    x[cells[part] & 1, vote[part] - low, cells[part] >> 1] = 1
    return x


def all_pair_agreement(vote_record: DataFrame, min_common: int, tile: int = 2048) -> DataFrame:
    """(a, b, agree, total, pct) of every two members, a < b, who both said yes or no in at least ``min_common`` votes.

    Members are cut into tiles of at most ``tile``.  A lot of votes is dealt out to each two tiles that meet in one
    of its votes, and a task counts all votes of two tiles in arrays of a number for each pair, so pairs
    leave it counted and cut.  Work grows with the yes and no of members who meet in a vote, or where a
    lot is full with dense products; memory with the square of ``tile``.
    """
    spark = vote_record.sparkSession
    ship(spark)
    own = vote_record.where(F.col("vote_value").isin(C.YES, C.NO) & F.col("person_id").isNotNull() & F.col("vote_id").isNotNull()).select("vote_id", "person_id", "vote_value")
    own = materialize(own, "sides")
    members = materialize(global_rank(own.select("person_id").distinct().withColumn("_all", F.lit(0)), "_all", "person_id", "person_id").select("person_id", F.col("rank0").cast("long").alias("rank")), "ranked-members")
    n, cores = members.count(), spark.sparkContext.defaultParallelism
    tile = max(1, min(tile, -(-n // math.isqrt(8 * cores))))  # tiles enough that every core gets some pairs of them
    tiles = max(1, -(-n // tile))
    kind = members.schema["person_id"].dataType

    def dealt(batches):
        for values, lengths in _lots(batches):
            key = np.unique(np.repeat(np.arange(len(lengths)), lengths) * (2 * n) + values)  # a member's yes or no counts once in a vote
            vote, cell = key // (2 * n), key % (2 * n)
            own_tile = cell // (2 * tile)
            order = np.argsort(own_tile, kind="stable")
            vote, cell, own_tile = vote[order], cell[order] - 2 * tile * own_tile[order], own_tile[order]
            there = np.zeros((len(lengths), tiles), bool)
            there[vote, own_tile] = True
            known, starts = np.unique(own_tile, return_index=True)
            sides = {t: (vote[i:j], cell[i:j].astype(np.uint16)) for t, i, j in zip(known.tolist(), starts, np.append(starts[1:], len(vote)))}
            out = []
            for ta, (va, ca) in sides.items():
                for tb, (vb, cb) in sides.items():
                    x, y = there[va, tb], there[vb, ta]
                    if ta <= tb and x.any():
                        out.append((ta * tiles + tb, va[x].astype(np.uint16).tobytes(), ca[x].tobytes(), vb[y].astype(np.uint16).tobytes(), cb[y].tobytes()))
                if len(out) >= 64:
                    yield _cells(out)
                    out = []
            if out:
                yield _cells(out)

    votes = own.join(members, "person_id").groupBy("vote_id").agg(F.collect_list(2 * F.col("rank") + (F.col("vote_value") == C.YES).cast("long")).alias("said"))
    cells = votes.select("said").mapInArrow(dealt, "pair long, va binary, a binary, vb binary, b binary").withColumn("ids", F.lit(None).cast(f"array<{kind.simpleString()}>")).withColumn("tb", F.lit(-1))
    # a task also gets the members of its tiles, as rows in front of the cells
    held = members.groupBy(F.floor(F.col("rank") / tile).alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "person_id"))), lambda x: x["person_id"]).alias("ids"))
    other, none = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("u"), F.lit(None).cast("binary")
    named = held.select("t", "ids", other).select(
        (F.least("t", "u") * tiles + F.greatest("t", "u")).alias("pair"), *[none.alias(c) for c in ("va", "a", "vb", "b")], "ids", F.when(F.col("t") == F.least("t", "u"), 0).otherwise(1).alias("tb"))
    tasks = min(tiles * (tiles + 1) // 2, max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ta, tb = F.floor(F.col("pair") / tiles), F.col("pair") % tiles
    number = F.pmod(ta * tiles - ta * (ta - 1) / 2 + tb - ta, F.lit(tasks)).cast("int")  # pairs of tiles in a row, dealt out by number
    rows = named.unionByName(cells).withColumn("_first", (F.col("tb") < 0).cast("int"))
    rows = rows.repartitionById(tasks, number).sortWithinPartitions("pair", "_first", "tb").select("pair", "va", "a", "vb", "b", "ids")

    def counted(batches):
        pair, ids, total, agree = None, [], None, None

        def results():
            if total is None:
                return
            if pair // tiles == pair % tiles:
                total[np.tril_indices(len(total))] = 0
            for low in range(0, len(total), max(1, (1 << 18) // total.shape[1])):
                high = low + max(1, (1 << 18) // total.shape[1])
                x, y = np.nonzero(total[low:high] >= max(min_common, 1))
                if len(x):
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(x + low)), ids[-1].take(pa.array(y)), pa.array(agree[low:high][x, y]), pa.array(total[low:high][x, y])], names=["a", "b", "agree", "total"])

        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column(0)[at].as_py() != pair:
                    yield from results()
                    pair, ids, total, agree = batch.column(0)[at].as_py(), [], None, None
                if batch.column(5)[at].is_valid:
                    ids.append(batch.column(5)[at].values)
                    continue
                if total is None:
                    total, agree = (np.zeros((len(ids[0]), len(ids[-1])), np.int64) for _ in range(2))
                sides = [np.frombuffer(batch.column(k)[at].as_buffer(), np.uint16).astype(np.int64) for k in range(1, 5)]
                _count_pairs(*sides, total, agree)
        yield from results()

    out = rows.mapInArrow(counted, f"a {kind.simpleString()}, b {kind.simpleString()}, agree long, total long")
    return out.withColumn("pct", F.bround(100 * F.col("agree") / F.col("total"), 0))


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pair", "va", "a", "vb", "b"])
