"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from votemill.plans import registry

HEADLINE = [
    "party_line", "party_deviation", "q_party_cohesion", "topic_classify_all", "speech_vote_alignment", "member_summary",
    "position_change", "party_distinctive_words", "word_style", "power_effect", "gov_winrate", "words_votes_ledger",
    "promise_keeping_party", "q_member_attributes", "q_party_covote_matrix", "q_member_party_agreement", "q_pair_agreement",
    "search_bm25", "search_bm25", "topk_vector", "political_map", "survey_party_stance", "src_vote_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("votemill-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    queries, seconds = registry.queries(), {}
    for name in (sys.argv[1:] or HEADLINE):
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        name = name if name not in seconds else f"{name}_again"
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
