"""Survey answers: one column per statement, aggregated to group positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill.functions import scalars as S


def unpivot_answers(wide: DataFrame, party_col: str, statements: dict[str, int]) -> DataFrame:
    """Wide answers to ``(party, statement_id, answer)``; only whole numbers 1 to 5 count."""
    ids = F.create_map(*[F.lit(x) for kv in statements.items() for x in kv])
    text = wide.select(F.trim(party_col).alias("party"), *[F.col(f"`{c}`").cast("string").alias(c) for c in statements])
    long = text.unpivot("party", list(statements), "statement", "raw")
    return (long.where(F.trim("raw").rlike(r"^\d+$"))
            .select("party", ids[F.col("statement")].alias("statement_id"), F.trim("raw").try_cast("int").alias("answer"))
            .where(F.col("answer").between(1, 5)))


def party_stance(answers: DataFrame, election: str, codes: dict[str, str] | None = None,
                 min_answers: int = 3) -> DataFrame:
    """Mean answer and share of agreement (4 or 5) per group and statement."""
    return (answers.groupBy("party", "statement_id")
            .agg(F.sum("answer").alias("s"), F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("answer") >= 4).alias("agree"))
            .where(F.col("n") >= min_answers)
            .select(F.lit(election).alias("election"), "party", S.party_code(F.col("party"), codes).alias("party_code"),
                    "statement_id", F.bround(F.col("s") / F.col("n"), 2).alias("mean"), "n",
                    F.bround(100 * F.col("agree") / F.col("n"), 1).alias("agree_pct")))
