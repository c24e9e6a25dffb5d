"""Distinctive words of groups and style rates of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from votemill import constants as C
from votemill.functions import text as X


def default_stopwords() -> list[str]:
    return sorted(set(C.STOPWORDS_GENERAL) | set(C.STOPWORDS_GROUPS))


def party_token_counts(speech: DataFrame, stopwords: list[str] | None = None,
                       min_len: int = C.WORDS_MIN_LEN) -> DataFrame:
    """Token counts per (party, word); stop words, short words and plain numbers are dropped.

    Counts are combined map-side, so a party holding most of the text does not matter.
    """
    stop = default_stopwords() if stopwords is None else stopwords
    word = F.col("word")
    return (speech.where(F.col("party").isNotNull() & F.col("text").isNotNull())
            # outer: a plain explode would push down a "not empty" filter that tokenizes twice
            .select("party", F.explode_outer(X.tokens(F.col("text"))).alias("word"))
            .where((F.length(word) >= min_len) & ~word.isin(stop) & ~word.rlike(r"^\p{Nd}+$"))
            .groupBy("party", "word").agg(F.count(F.lit(1)).alias("n")))


def party_distinctive_words(counts: DataFrame, *, min_party_total: int = C.WORDS_MIN_PARTY_TOTAL,
                            min_count: int = C.WORDS_MIN_COUNT, top_n: int = C.WORDS_TOP_N,
                            prior: float = C.WORDS_PRIOR) -> DataFrame:
    """Top words per party by z-score of the log-odds with an informative Dirichlet prior.

    ``counts`` comes from :func:`party_token_counts` and is read several times:
    hand over a written table when the text is large.  A word that a party never
    used scores below all that it used more than expected, so unused words are
    added only for parties with fewer than ``top_n`` words of their own.
    """
    totals = counts.groupBy("party").agg(F.sum("n").alias("ni")).where(F.col("ni") >= min_party_total)
    total_all = counts.agg(F.sum("n")).scalar()
    vocab = counts.groupBy("word").agg(F.sum("n").alias("n_total")).where(F.col("n_total") >= min_count)
    yi, aw = F.col("yi"), F.col("aw")
    used = counts.withColumnRenamed("n", "yi").join(vocab, "word").join(totals, "party").select("party", "word", "yi", "ni", "n_total")
    expected = F.col("ni") * F.col("n_total") / total_all
    short = (totals.join(used.where(yi > expected).groupBy("party").agg(F.count(F.lit(1)).alias("own")), "party", "left")
             .where(F.coalesce("own", F.lit(0)) < top_n).select("party", "ni"))
    salts = 16
    dealt = short.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    unused = (vocab.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(salts))).join(dealt, "_salt")
              .join(counts.select("party", "word"), ["party", "word"], "left_anti")
              .select("party", "word", F.lit(0).cast("long").alias("yi"), "ni", "n_total"))
    scored = (used.unionByName(unused).withColumn("nn", total_all)
              .withColumn("aw", prior * F.col("n_total") / F.col("nn"))
              .withColumn("num_i", yi + aw)
              .withColumn("den_i", F.col("ni") + prior - yi - aw)
              .withColumn("num_j", F.col("n_total") - yi + aw)
              .withColumn("den_j", (F.col("nn") - F.col("ni")) + prior - (F.col("n_total") - yi) - aw)
              .where("num_i > 0 and den_i > 0 and num_j > 0 and den_j > 0")
              .withColumn("z", (F.log(F.col("num_i") / F.col("den_i")) - F.log(F.col("num_j") / F.col("den_j")))
                          / F.sqrt(1.0 / F.col("num_i") + 1.0 / F.col("num_j"))))
    top = W.partitionBy("party").orderBy(F.desc(F.round("z", 9)), F.desc("word"))
    return (scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= top_n)
            .select("party", "word", F.round("z", 2).alias("zscore"), yi.alias("n_party"), "n_total", "rank"))


def default_style_lexicon() -> dict[str, tuple[list[str], list[str]]]:
    return {"filler": (list(C.FILLER_WORDS), list(C.FILLER_PHRASES)),
            "swear": (list(C.SWEAR_WORDS), list(C.SWEAR_PHRASES))}


WORDS = "words"


def style_counts(speech: DataFrame, lexicon: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Lexicon hits per (person, category, word) and, as category ``words``, all words of a person; one pass over the texts, only counts are shuffled."""
    lexicon = lexicon or default_style_lexicon()
    toks = (speech.where(F.col("person_id").isNotNull() & F.col("text").isNotNull())
            .select("person_id", X.tokens(F.col("text")).alias("_t")))

    def tagged(cat, single, phrases):
        return F.transform(X.lexicon_hits(F.col("_t"), single, phrases),
                           lambda w: F.struct(F.lit(cat).alias("category"), w.alias("word")))

    found = F.concat(*[tagged(cat, *words) for cat, words in lexicon.items()])
    counted = F.concat(F.transform(found, lambda h: F.struct(h["category"].alias("category"), h["word"].alias("word"), F.lit(1).cast("long").alias("n"))),
                       F.array(F.struct(F.lit(WORDS).alias("category"), F.lit("").alias("word"), F.size("_t").cast("long").alias("n"))))
    return (toks.select("person_id", F.inline_outer(counted)).groupBy("person_id", "category", "word")
            .agg(F.sum("n").alias("n")))


def style_hits(counts: DataFrame) -> DataFrame:
    """The hits among :func:`style_counts`."""
    return counts.where(F.col("category") != WORDS)


def word_style(counts: DataFrame, person: DataFrame,
               lexicon: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Hits per 1000 words for each registered member and category; members without hits stay with 0."""
    lexicon = lexicon or default_style_lexicon()
    words = (counts.where(F.col("category") == WORDS).select("person_id", F.col("n").alias("n_words"))
             .join(person.select("person_id"), "person_id", "left_semi"))
    grid = words.withColumn("category", F.explode(F.array(*[F.lit(c) for c in lexicon])))
    hits = style_hits(counts).groupBy("person_id", "category").agg(F.sum("n").alias("n_hits"))
    rate = F.when(F.col("n_words") > 0, 1000.0 * F.col("n_hits") / F.col("n_words")).otherwise(0.0)
    return (grid.join(hits, ["person_id", "category"], "left").na.fill(0, ["n_hits"])
            .select("person_id", "category", "n_hits", "n_words", F.round(rate, 3).alias("per_1000")))


def top_style_words(hits: DataFrame, person: DataFrame, top_n: int = 20) -> DataFrame:
    """The most frequent hit words per (member, category), ties by word."""
    w = W.partitionBy("person_id", "category").orderBy(F.desc("n"), "word")
    return (hits.join(person.select("person_id"), "person_id", "left_semi")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n))
