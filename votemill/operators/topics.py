"""Lexicon topic classification: one map-only pass, no shuffle and no lexicon join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votemill import constants as C
from votemill.functions import scalars as S, text as X

Lexicon = list[tuple[int, str, str, list[tuple[str, float]]]]


def default_lexicon() -> Lexicon:
    return list(C.TOPIC_LEXICON)


def topic_tables(spark: SparkSession, lexicon: Lexicon | None = None) -> tuple[DataFrame, DataFrame]:
    """The lexicon as ``topic`` and ``topic_keyword`` tables; ids follow declaration order."""
    lexicon = lexicon or default_lexicon()
    topic = spark.createDataFrame([(i, s, l) for i, s, l, _ in lexicon], "id int, slug string, label string")
    keyword = spark.createDataFrame(
        [(i, k, w) for i, _, _, kws in lexicon for k, w in kws],
        "topic_id int, keyword string, weight double")
    return topic, keyword


def keywords(lexicon: Lexicon) -> list[str]:
    return [k for _, _, _, kws in lexicon for k, _ in kws]


def with_candidates(items: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, _length, _cands): number of tokens, and what the lexicon can match of them."""
    line = items.select(F.col(id_col), X.token_line(F.col(text_col)).alias("_line"))
    return line.select(id_col, X.line_length(F.col("_line")).alias("_length"), X.candidate_line(F.col("_line"), keywords(lexicon)).alias("_cands"))


def topic_scores(lexicon: Lexicon, fallback: str = C.FALLBACK_TOPIC, min_tokens: int = C.TOPIC_MIN_TOKENS) -> Column:
    """Array of (topic_id, score): weighted prefix hits over the root of the text length, of rows of :func:`with_candidates`.

    The text is passed over once; keywords are counted among the candidates.
    """
    scale = F.sqrt(F.greatest(F.col("_length"), F.lit(min_tokens)).cast("double"))
    entries = []
    for tid, slug, _, kws in lexicon:
        if slug == fallback:
            continue
        raw = reduce(lambda a, b: a + b, [X.candidate_count(F.col("_cands"), k) * F.lit(w) for k, w in kws])
        entries.append(F.struct(F.lit(tid).alias("topic_id"), (raw / scale).alias("score")))
    return F.array(*entries)


def assign_topics(items: DataFrame, id_col: str, text_col: str, lexicon: Lexicon | None = None, *,
                  fallback: str = C.FALLBACK_TOPIC, hard: float = C.TOPIC_HARD_THRESHOLD,
                  dominance: float = C.TOPIC_DOMINANCE, keep: int = C.TOPIC_MAX_PER_ITEM) -> DataFrame:
    """Up to ``keep`` topics per item: ``(id, topic_id, score, is_primary, status)``.

    Scores, ranking and the fallback are per-row array expressions.
    """
    lexicon = lexicon or default_lexicon()
    fallback_id = next(i for i, s, _, _ in lexicon if s == fallback)
    scored = (with_candidates(items, id_col, text_col, lexicon).withColumn("_scores", topic_scores(lexicon, fallback))
              .withColumn("_top", F.array_max(F.transform("_scores", lambda s: s["score"]))))
    ranked = F.array_sort(F.transform(
        F.filter("_scores", lambda s: (s["score"] >= dominance * F.col("_top")) & (s["score"] >= hard)),
        lambda s: F.struct((-s["score"]).alias("neg"), s["topic_id"].alias("topic_id"))))
    none = F.array(F.struct(F.lit(0.0).alias("neg"), F.lit(fallback_id).alias("topic_id")))
    matched = F.col("_top") >= hard
    chosen = scored.select(id_col, F.when(matched, F.slice(ranked, 1, keep)).otherwise(none).alias("_chosen"),
                           matched.alias("_matched"))
    return (chosen.select(
        id_col,
        F.when(~F.col("_matched"), "NO_MATCH").when(F.size("_chosen") > 1, "MULTI").otherwise("SINGLE").alias("status"),
        # never empty; the outer form keeps Spark from scoring again in a pushed-down filter
        F.posexplode_outer("_chosen"))
        .select(id_col, F.col("col.topic_id").alias("topic_id"),
                F.round(F.abs(F.col("col.neg")), 4).alias("score"),
                (F.col("pos") == 0).cast("int").alias("is_primary"), "status"))


VOTE_TEXT_COLUMNS = ("title", "item_title", "main_item_title", "treatment_title", "legislative_item", "extra_title")


def vote_texts(vote: DataFrame, legislation: DataFrame) -> DataFrame:
    """Text of each vote: its own titles plus title and summary of the bill.

    The headers, a few short columns, are dealt out first: a small table would
    meet the long summaries in one task, and be scored there.
    """
    parts = int(vote.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bill = legislation.select(F.col("eduskunta_tunnus").alias("legislative_item"),
                              F.col("title").alias("_lt"), F.col("summary").alias("_ls"))
    return (vote.select("vote_id", *VOTE_TEXT_COLUMNS).repartition(parts).join(bill, "legislative_item", "left")
            .select("vote_id", S.joined(*[F.col(c) for c in VOTE_TEXT_COLUMNS], F.col("_lt"), F.col("_ls")).alias("text")))


def classify_all(speech: DataFrame, vote: DataFrame, legislation: DataFrame,
                 lexicon: Lexicon | None = None, **kw) -> DataFrame:
    """Topics of every speech and every vote, tagged by ``item_type``."""
    s = assign_topics(speech, "id", "text", lexicon, **kw).withColumnRenamed("id", "item_id")
    v = assign_topics(vote_texts(vote, legislation), "vote_id", "text", lexicon, **kw) \
        .withColumnRenamed("vote_id", "item_id")
    return s.withColumn("item_type", F.lit("speech")).unionByName(v.withColumn("item_type", F.lit("vote")))
