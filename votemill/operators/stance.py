"""Speech stances, the words-versus-votes ledger, and work lists for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from votemill import constants as C
from votemill.functions import scalars as S


def _has_item(col: str = "legislative_item") -> Column:
    return F.col(col).isNotNull() & (F.col(col) != "")


def _voted_items(vote: DataFrame, where: Column | None = None) -> DataFrame:
    v = vote.where(_has_item())
    return (v if where is None else v.where(where)).select("legislative_item").distinct()


def stance_candidates(speech: DataFrame, vote: DataFrame, *, min_chars: int = 200,
                      only_with_votes: bool = True, limit: int | None = None) -> DataFrame:
    """Speeches on a bill long enough to analyse, by default only bills that were voted on."""
    out = speech.where(F.col("person_id").isNotNull() & (F.length("text") > min_chars) & _has_item())
    if only_with_votes:
        out = out.join(_voted_items(vote), "legislative_item", "left_semi")
    out = out.select("id", "person_id", "legislative_item", "text", "started_at")
    return out.orderBy("id").limit(limit) if limit else out


def export_candidates(speech: DataFrame, vote: DataFrame, stance: DataFrame, *, clean_only: bool = True,
                      min_chars: int = 300, max_chars: int = 2600, limit: int | None = None) -> DataFrame:
    """Speeches not analysed yet, cut and labelled, as a work list."""
    out = (speech.where(F.col("person_id").isNotNull() & (F.length("text") > min_chars) & _has_item())
           .join(stance.select(F.col("speech_id").alias("id")), "id", "left_anti"))
    if clean_only:
        clean = (F.col("is_procedural") == 0) & S.is_clean_vote(F.col("title"))
        out = out.join(_voted_items(vote, clean), "legislative_item", "left_semi")
    out = out.select(F.col("id").alias("speech_id"), "legislative_item",
                     S.speaker_label(F.col("first_name"), F.col("last_name"), F.col("party")).alias("speaker"),
                     S.preview(F.col("text"), max_chars).alias("text"))
    return out.orderBy("legislative_item", "speech_id").limit(limit) if limit else out


def longest_speeches(speech: DataFrame, n: int, *, min_chars: int = 300) -> DataFrame:
    """The ``n`` longest speeches per bill; only ``n`` per task leave the map side."""
    w = W.partitionBy("legislative_item").orderBy(F.desc(F.length("text")), "id")
    return (speech.where(F.col("person_id").isNotNull() & (F.length("text") > min_chars) & _has_item())
            .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n))


def vote_debates(speech: DataFrame, vote: DataFrame, legislation: DataFrame, stance: DataFrame,
                 proscons: DataFrame, *, n_speeches: int = 12, max_chars: int = 900,
                 summary_chars: int = 1500, limit: int | None = None) -> DataFrame:
    """Clean votes still without arguments, with a nested list of the longest speeches of the bill."""
    todo = (vote.where((F.col("is_procedural") == 0) & S.is_clean_vote(F.col("title"), with_reports=False))
            .join(stance.select("legislative_item"), "legislative_item", "left_semi")
            .join(proscons.select("vote_id"), "vote_id", "left_anti")
            .select("vote_id", "legislative_item"))
    if limit:
        todo = todo.orderBy("vote_id").limit(limit)
    debate = (longest_speeches(speech, n_speeches).groupBy("legislative_item")
              .agg(F.sort_array(F.collect_list(F.struct(
                  "pos", F.concat("first_name", F.lit(" "), "last_name").alias("speaker"), "party",
                  S.preview(F.col("text"), max_chars).alias("text")))).alias("debate")))
    bill = legislation.select(F.col("eduskunta_tunnus").alias("legislative_item"),
                              S.preview(F.col("summary"), summary_chars).alias("summary"))
    return (todo.join(bill, "legislative_item", "left").join(debate, "legislative_item", "left")
            .select("vote_id", "legislative_item", F.coalesce("summary", F.lit("")).alias("summary"),
                    F.coalesce("debate", F.array().cast(debate.schema["debate"].dataType)).alias("debate")))


def explain_candidates(legislation: DataFrame, vote: DataFrame, speech: DataFrame, *, min_summary: int = 120,
                       n_speeches: int = 8,
                       max_speech: int = C.EXPLAIN_MAX_SPEECH, max_summary: int = C.EXPLAIN_MAX_SUMMARY) -> DataFrame:
    """Voted bills with a summary, and the material to explain them from."""
    items = (legislation.where(F.length("summary") > min_summary)
             .select(F.col("eduskunta_tunnus").alias("legislative_item"), "title", "summary")
             .join(vote.select("legislative_item"), "legislative_item", "left_semi"))
    part = F.concat(S.speaker_label(F.col("first_name"), F.col("last_name"), F.col("party")), F.lit(": "),
                    S.preview(F.col("text"), max_speech))
    debate = (longest_speeches(speech, n_speeches).groupBy("legislative_item")
              .agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
              .select("legislative_item", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("debate")))
    return (items.join(debate, "legislative_item", "left")
            .select("legislative_item", "title", S.preview(F.col("summary"), max_summary).alias("summary"),
                    F.coalesce("debate", F.lit("")).alias("debate")))


def stance_from_extractions(extraction: DataFrame, speech: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Rows of the stance table from extraction results ``(speech_id, response_json, model)``.

    Propositions without a quote or with an unknown stance are dropped; speeches
    with a result replace all their earlier rows.
    """
    kind = ("struct<propositions:array<struct<proposition:string,stance:string,conditional_note:string,"
            "evidence_quote:string,confidence:double>>>")
    parsed = extraction.select("speech_id", "model", F.from_json("response_json", kind).alias("j"))
    new = (parsed.select("speech_id", "model", F.inline_outer("j.propositions"))
           .where((F.col("evidence_quote") != "") & F.col("stance").isin(*C.STANCES))
           .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
           .join(speech.select(F.col("id").alias("speech_id"), "person_id", "legislative_item"), "speech_id"))
    cols = ["speech_id", "person_id", "legislative_item", "proposition", "stance", "conditional_note",
            "evidence_quote", "confidence", "model"]
    new = new.select(*cols)
    if previous is None:
        return new
    kept = previous.join(extraction.select("speech_id"), "speech_id", "left_anti").select(*cols)
    return kept.unionByName(new)


def dominant_stance(stance: DataFrame) -> DataFrame:
    """One stance per (person, bill) and the row that stands for it.

    ``stance`` needs a unique ``id``; equal confidence goes to the lowest.
    """
    def best(name):
        key = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("id")).alias("i"))
        return F.max_by(F.struct("id", "speech_id", "evidence_quote", "confidence", "model"),
                        F.when(F.col("stance") == name, key)).alias(f"b_{name}")

    def weight(name):
        return F.sum(F.when(F.col("stance") == name, F.coalesce("confidence", F.lit(0.0)) + 0.01).otherwise(0.0))

    g = (stance.where(F.col("person_id").isNotNull() & _has_item() & F.col("stance").isin(*C.STANCES))
         .groupBy("person_id", "legislative_item")
         .agg(weight(C.STANCE_FOR).alias("wf"), weight(C.STANCE_AGAINST).alias("wa"), *[best(s) for s in C.STANCES]))
    wf, wa = F.col("wf"), F.col("wa")
    neither, both = (wf == 0) & (wa == 0), (wf > 0) & (wa > 0)
    mixed = both & (F.least(wf, wa) / F.greatest(wf, wa) > 0.5)
    b = {s: F.col(f"b_{s}") for s in C.STANCES}
    label = (F.when(neither & b[C.STANCE_COND].isNotNull(), C.STANCE_COND).when(neither, C.STANCE_NONE)
             .when(mixed, C.STANCE_COND).when(wf >= wa, C.STANCE_FOR).otherwise(C.STANCE_AGAINST))
    rep = (F.when(neither, F.coalesce(b[C.STANCE_COND], b[C.STANCE_NONE]))
           .when(mixed, F.coalesce(b[C.STANCE_FOR], b[C.STANCE_AGAINST]))
           .when(wf >= wa, b[C.STANCE_FOR]).otherwise(b[C.STANCE_AGAINST]))
    return (g.select("person_id", "legislative_item", label.alias("dominant"), rep.alias("r"))
            .select("person_id", "legislative_item", "dominant", F.col("r.id").alias("stance_id"),
                    F.col("r.speech_id").alias("speech_id"), F.col("r.evidence_quote").alias("evidence_quote"),
                    F.col("r.confidence").alias("confidence"), F.col("r.model").alias("model")))


def words_votes_ledger(stance: DataFrame, speech: DataFrame, vote: DataFrame, vote_record: DataFrame,
                       min_confidence: float = C.CONFLICT_MIN_CONFIDENCE) -> DataFrame:
    """Every vote on a bill a member took a stance on, classed by an explicit rule.

    A missing vote record still gives a row.  Stances without their speech do
    not take part in the choice of the dominant one.
    """
    spoken = stance.join(speech.select(F.col("id").alias("speech_id")), "speech_id", "left_semi")
    rep = (dominant_stance(spoken)
           .join(speech.select(F.col("id").alias("speech_id"), F.col("started_at").alias("speech_date"),
                               S.reluctance(F.col("text")).alias("marker")), "speech_id"))
    v = vote.where(_has_item()).select("vote_id", "legislative_item", "title", F.col("session_date").alias("vote_date"),
                                       F.col("treatment_stage").alias("vote_stage"), "is_procedural")
    led = (rep.join(v, "legislative_item")
           .join(vote_record.select("vote_id", "person_id", "vote_value"), ["vote_id", "person_id"], "left"))
    value, st = F.col("vote_value"), F.col("dominant")
    no_vote = value.isNull() | value.isin(C.BLANK, C.ABSENT, "")
    same = ((st == C.STANCE_FOR) & (value == C.YES)) | ((st == C.STANCE_AGAINST) & (value != C.YES))
    unsure = F.coalesce("confidence", F.lit(0.0)) < min_confidence
    cases = [
        (no_vote, C.INSUFFICIENT, F.concat(F.lit("ääni oli "), F.coalesce(F.nullif(value, F.lit("")), F.lit("tuntematon")))),
        (F.col("is_procedural") != 0, C.CONTEXT, F.lit(C.NOTE_PROCEDURAL)),
        (~S.is_bill_passage(F.col("title")), C.CONTEXT, F.lit(C.NOTE_UNCLEAR_VOTE)),
        (st.isin(C.STANCE_COND, C.STANCE_NONE), C.CONTEXT, F.lit(C.NOTE_OPEN_STANCE)),
        (same, C.ALIGNED, F.lit(C.NOTE_ALIGNED)),
        (F.col("marker").isNotNull(), C.RELUCTANT,
         F.concat(F.lit('puheessa avoin kompromissisignaali: "'), F.col("marker"), F.lit('"'))),
        (unsure, C.CONTEXT, F.lit(C.NOTE_UNSURE)),
    ]
    label, note = F.lit(C.CONFLICT), F.lit(C.NOTE_CONFLICT)
    for cond, a, n in reversed(cases):
        label, note = F.when(cond, a).otherwise(label), F.when(cond, n).otherwise(note)
    return led.select("person_id", "vote_id", "speech_id", "legislative_item", st.alias("speech_stance"),
                      F.col("evidence_quote").alias("speech_quote"), "speech_date", "vote_value", "vote_date",
                      "vote_stage", label.alias("alignment"), note.alias("context_note"), "confidence", "model")
