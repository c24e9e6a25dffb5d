"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votemill.llm import ann, bpe, filter_audit, lm, ngram_join, packing, quality, simhash, suffix_dedup, token_counts, toxicity, warc, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % of


def held_out(key: str, of: int, fold: int = 2) -> Column:
    """Rows never learnt from; a row without key is one."""
    return F.coalesce(remainder(key, of) == fold, F.lit(True))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(documents(spark, sf_dir), keep=["doc_id"])
    return ngram_join.with_component_id(joined, "doc_id").select("row.doc_id", "n_shingles", "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(documents(spark, sf_dir), keep=["doc_id"], path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), size=1024)
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), held_out("doc_id", 7), keep=["doc_id"]).select(
        "row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(documents(spark, sf_dir), keep=["doc_id"], path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("row.doc_id", "n_tokens")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(documents(spark, sf_dir), keep=["doc_id"])
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = warc.read(warc.archive(pages), with_payload=False)
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, marks = toxicity.training_sample(docs, labels, ~held_out("doc_id", 4))
    scored = toxicity.score(docs, toxicity.fit(texts, marks), keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(spark, sf_dir), keep=["doc_id"], path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir), keep=["doc_id"], cleaned=False)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.text_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(rows, filter_audit.failing_ids(rows, {f: F.col(f) for f in "ABCDE"}))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_component_id(simhash.near_duplicates(documents(spark, sf_dir), keep=["doc_id"]), "doc_id")
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_packing, op3_lm, op4_token_counts, op5_suffix_dedup, op6_warc, op7_toxicity, op8_ann, op9_bpe, op10_quality, op11_filter_audit, op12_simhash, op13_whitening)
}
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
        s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' /' || len(ws)] ELSE [] END) AS g FROM w),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
        link AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2) JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
        reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1) USING (r)""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT r, p, md5(b[p:p + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d)),
        hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w JOIN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1) USING (h)),
        run AS (SELECT r, g, min(p) AS s, max(p) + 400 AS e FROM (SELECT r, p, sum(CASE WHEN p - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit) GROUP BY 1, 2),
        cut AS (SELECT r, count(*) AS n_spans, cast(sum(e - s) AS bigint) AS n_removed FROM run GROUP BY 1),
        rest AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS s, s - 1 AS e FROM run UNION ALL SELECT r, max(e), 1000000000 FROM run GROUP BY 1),
        kept AS (SELECT r, unhex(string_agg(hex(b[s:e]), '' ORDER BY s)) AS k FROM rest JOIN d USING (r) GROUP BY 1)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
        FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)""",
    "op10_quality": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        line AS (SELECT r, l, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
        seen AS (SELECT r, l, len(lw) AS nw, coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) AS ch, len(regexp_extract_all(l, '[.!?:;{quality.WIDE_MARKS}]')) AS marks,
          len(regexp_extract_all(l, '[{quality.SEPARATORS}]')) AS parts, len(regexp_extract_all(l, '[#*$%&|<>]')) AS sym, {' OR '.join(f"contains(low, '{p}')" for p in quality.PHRASES)} AS stock FROM line),
        judged AS (SELECT *, nw > 0 AND ((parts >= 3 AND 100 * parts >= 20 * nw) OR (stock AND nw <= 30) OR 100 * sym > 10 * ch
          OR (marks = 0 AND nw BETWEEN 8 AND 30 AND sum(marks) OVER (PARTITION BY r) > 0)) AS bad FROM seen),
        lines AS (SELECT r, count(*) FILTER (nw > 0) - count(DISTINCT l) FILTER (nw > 0) AS n_dup_lines, coalesce(sum(ch) FILTER (bad), 0) AS lost FROM judged GROUP BY 1),
        win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
        rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
        f AS (SELECT r, doc_id, cast(len(ws) AS bigint) AS n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS bigint) AS word_chars,
          cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS bigint) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, lost FROM d JOIN lines USING (r) LEFT JOIN rep USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
          NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words > 0 AND lost <= 0.5 * word_chars AS kept FROM f""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        f AS (SELECT r, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails,
          EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
        c AS (SELECT part, list_transform(fails, lambda x: cast(x AS int)) AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
        p AS (SELECT part, count(*) AS rows FROM d GROUP BY 1),
        l AS (SELECT unnest(range(1, 6)) AS k),
        o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        s AS (SELECT ks, s.k AS step FROM o, l s),
        m AS (SELECT p.part, any_value(rows) AS rows, ks, step,
          coalesce(sum(n) FILTER (list_sum(list_transform(ks[:step], lambda q: fails[q])) > 0), 0) AS gone,
          coalesce(sum(n) FILTER (fails[ks[step]] = 1), 0) AS failing,
          coalesce(sum(n) FILTER (fails[ks[step]] = 1 AND list_sum(fails) = 1), 0) AS unique_fails,
          coalesce(sum(n) FILTER (fails[ks[step]] = 1 AND list_sum(list_transform(ks[:step], lambda q: fails[q])) = 1), 0) AS removed,
          coalesce(sum(g) FILTER (fails[ks[step]] = 1 AND list_sum(list_transform(ks[:step], lambda q: fails[q])) = 1), 0) AS good_lost,
          coalesce(sum(x) FILTER (fails[ks[step]] = 1 AND list_sum(list_transform(ks[:step], lambda q: fails[q])) = 1), 0) AS toxic_lost
          FROM p JOIN c ON c.part = p.part CROSS JOIN s GROUP BY 1, 3, 4)
        SELECT part, list_aggregate(list_transform(ks, lambda q: substring('ABCDE', q, 1)), 'string_agg', '') AS filter_order, cast(step AS int) AS step, cast(rows - gone AS bigint) AS kept, cast(removed AS bigint) AS removed,
          cast(failing - removed AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost,
          cast(sum(removed) OVER (PARTITION BY part, ks[step]) AS bigint) AS shapley FROM m""",
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
