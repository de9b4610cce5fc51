"""Headline-query benchmark.

Runs each headline query to completion (``noop`` sink: every row is produced,
nothing is collected on the driver) at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "curated_sentences",      # M12 corpus curation
    "pool_build",             # M13 pools with context
    "votes_wawa",             # A8 worker-weighted vote
    "votes_unaligned_workers",  # A11 worker F1
    "votes_consolidate",      # M14 vote consolidation
    "split_stratified",       # M1 stratified split
    "metrics_agreement",      # M16 agreement report
    "tfidf_weights",          # M5 exact TF-IDF
    "padded_batches",         # M10 padded batches
    "render_html",            # S8 + W6 + S11 labelled pages
    "best_epoch",             # W8 experiment selection
    "tfidf_logreg",           # M4 baseline model
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from tessera.queries import Q
    from tessera.session import build_session

    # one shuffle partition per local core (measured faster than two at sf0.1)
    partitions = int(os.environ.get("BENCH_PARTITIONS", cpus))
    spark = build_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=partitions,
                          # a folder all executors share; needed only where spark.checkpoint.dir is unset
                          fallback_checkpoint_dir=os.environ.get("BENCH_CHECKPOINT_DIR"),
                          # the text tables are one row group each at this size: dealt over the cores
                          extra={"spark.driver.memory": "16g", "tessera.scan.partitions": str(cpus)})
    # warm-up: JVM start, parquet footers
    Q["scan_articles"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.perf_counter()
        Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
