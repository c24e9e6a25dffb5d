"""Full-text (BM25) and vector retrieval."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from votemill import constants as C
from votemill.functions import scalars as S, text as X
from votemill.operators import postings


Index = postings.Index


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> Index:
    """Writes the index of all texts below ``path``, in place of an older one there."""
    return postings.build(docs, id_col, text_col, path)


def _query(index: Index, phrases: list[list[str]], require_all: bool) -> postings.Query:
    return postings.Query(index, phrases, require_all, postings.Weights(C.BM25_K1, C.BM25_B, C.BM25_IDF_FLOOR))


def bm25(index: Index, phrases: list[list[str]], *, require_all: bool = False) -> DataFrame:
    """BM25 score ``(id, score)`` of each text holding any (or all) of the phrases, each a run of folded terms.

    A phrase is counted by the places where all its terms stand in order.
    """
    query = _query(index, phrases, require_all)
    return query.scores() if query.answerable() else query.none()


def bm25_top(index: Index, phrases: list[list[str]], k: int, *, require_all: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of :func:`bm25`, ties by id, without scoring what cannot be among them."""
    return postings.top(_query(index, phrases, require_all), k, allowed)


def fold_phrases(query: str, min_length: int = 1) -> list[list[str]]:
    """Phrases of a literal query: each blank-separated word, folded the way texts are indexed; a separator inside a word makes it a run of terms."""
    table = str.maketrans(X.FOLD_FROM, X.FOLD_TO)
    out = []
    for word in unicodedata.normalize("NFC", query).replace('"', " ").split():
        if len(word) >= min_length:
            folded = re.sub(X.MARKS, "", word.lower()).translate(table)
            out.append("".join(c if c.isalnum() else " " for c in folded).split())
    return [p for p in out if p]


def retrieve(index: Index, speech: DataFrame, query: str, *, person_id: int | None = None, k: int = 8,
             max_chars: int = 700) -> DataFrame:
    """Top ``k`` passages for a question: any term of two letters or more, best BM25 first."""
    own = speech.where(F.col("person_id") == person_id).select("id") if person_id is not None else None
    best = bm25_top(index, fold_phrases(query, 2), k, allowed=own)  # texts are fetched for the k best only
    return (best.join(speech, "id").orderBy(F.desc(F.round("score", 9)), "id")
            .select("id", F.concat("first_name", F.lit(" "), "last_name").alias("who"), "party", "started_at",
                    "legislative_item", S.preview(F.col("text"), max_chars).alias("text"), "person_id",
                    F.round("score", 6).alias("score")))


def search_people(person: DataFrame, query: str, limit: int = 30) -> DataFrame:
    return (person.where(F.col("full_name").ilike(f"%{query}%"))
            .select("person_id", "full_name", "party_current", "electoral_district")
            .orderBy("full_name", "person_id").limit(limit))


def search_votes(vote: DataFrame, query: str, limit: int = 30) -> DataFrame:
    like = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
                                       for c in ("title", "legislative_item", "item_title")])
    return (vote.where(like).select("vote_id", "session_date", "title", "legislative_item")
            .orderBy(F.desc("session_date"), "vote_id").limit(limit))


def search_speeches(index: Index, speech: DataFrame, query: str, limit: int = 30, width: int = 12) -> DataFrame:
    """Speeches holding all words of the query, best first, with a marked snippet."""
    phrases = fold_phrases(query)
    terms = sorted({t for p in phrases for t in p})
    hits = bm25_top(index, phrases, limit, require_all=True)
    arr = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return hits.join(speech, "id").select(
        "id", "first_name", "last_name", "party", "ptk_id", "started_at", F.round("score", 6).alias("score"),
        X.snippet(F.col("text"), arr, width).alias("snip"))


def search_speeches_like(speech: DataFrame, query: str, limit: int = 30, chars: int = 160) -> DataFrame:
    """Plain substring search, the fallback without an index."""
    return (speech.where(F.col("text").ilike(f"%{query}%"))
            .orderBy("id").limit(limit)
            .select("id", "first_name", "last_name", "party", "ptk_id", "started_at",
                    S.preview(F.col("text"), chars).alias("snip")))


def search_all(person: DataFrame, vote: DataFrame, index: Index, speech: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Hits of the three searches as one tagged table."""
    def tagged(df, kind, key, label):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"))

    return (tagged(search_people(person, query, limit), "person", "person_id", "full_name")
            .unionByName(tagged(search_votes(vote, query, limit), "vote", "vote_id", "title"))
            .unionByName(tagged(search_speeches(index, speech, query, limit), "speech", "id", "snip")))


def unit_vector(vec):
    """Array column scaled to unit length."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / norm)


def cosine_top_k(embedding: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int = 30) -> DataFrame:
    """Top ``k`` rows by cosine with the query, a one-row frame with one array column."""
    probe = query.select(unit_vector(F.col(query.columns[0]))).scalar()
    dot = F.aggregate(F.zip_with(unit_vector(F.col(vec_col)), F.col("_q"), lambda a, b: a * b),
                      F.lit(0.0), lambda acc, p: acc + p)
    return (embedding.withColumn("_q", probe).select(id_col, F.round(dot, 9).alias("score"))
            .orderBy(F.desc("score"), id_col).limit(k))


def by_id_order(speech: DataFrame, hits: DataFrame, id_col: str = "id", chars: int = 220) -> DataFrame:
    """Speeches for a ranked id list, in its order, with scores and previews."""
    ranked = hits.select("pos", F.col(id_col).alias("id"), F.bround("score", 3).alias("score"))
    return (ranked.join(speech, "id")
            .select("pos", "id", "person_id", "first_name", "last_name", "party", "ptk_id", "started_at",
                    "legislative_item", S.preview(F.col("text"), chars).alias("snip"), "score").orderBy("pos"))
