"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores, and
BENCH_QUERIES optionally a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

from itembank.plans import QUERIES
from itembank.session import local_session

HEADLINE = [
    "a1_session_summary", "a4_weak_points", "a5_library_totals", "a8_library_weak", "a10_wrong_book", "w1_progress", "w2_streak",
    "o1_due_rank", "j1_bank_overview", "j7_star_grade", "s1_text_lines", "s7_keyed_upsert", "s12_practice_sheet", "p2_qid",
    "g4_segment_units", "g10_finalize", "n2_sentences", "n5_key_terms", "n13_choice_items", "l2_line_text", "l6_reading_order",
    "m1_chunk_lines", "m6_llm_items", "t1_stream_wrong_book", "t2_stream_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "itembank-bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "itembank_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
