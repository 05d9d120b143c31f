"""Times the headline queries: one warm-up run of each, then the best of BENCH_REPEATS runs, written to the no-op sink."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sourcemart.checks import REGISTRY  # noqa: E402
from sourcemart.model import Tables  # noqa: E402
from sourcemart.session import build_session  # noqa: E402

HEADLINES = [
    "search", "f_terms_and", "f_category_tree", "f_tags", "f_latest", "s_price", "s_relevance", "a_facet_count", "a_facet_price",
    "a_stats", "a_quality", "a_bm25", "j_scalar_overlay", "retrieve", "lane_report", "w_interleave", "w_latest_revision",
    "intake_dedup", "manifest_diff", "lines_evidence", "commit_idempotent", "table_records", "derive", "enrich", "context_hash",
    "verify_drift", "st_fold", "st_fold_batch", "audit_secrets", "paginate_text",
]


def run(spark, folder: str, key: str) -> float:
    start = time.perf_counter()
    REGISTRY[key].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(cores, int(cores) if cores.isdigit() else 8, "16g")
    spark.sparkContext.setLogLevel("OFF")
    start = time.perf_counter()
    Tables(spark, folder).library()  # queries over texts read this index, which is made once
    ingest = round(time.perf_counter() - start, 3)
    seconds = {}
    for key in HEADLINES:
        run(spark, folder, key)
        seconds[key] = round(min(run(spark, folder, key) for _ in range(repeats)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of best times", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "ingest": {"text_index": ingest}, "sf": float(folder.rstrip("/").rsplit("sf", 1)[-1])}))


if __name__ == "__main__":
    main()
