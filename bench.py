"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["D2_rating_aggregates", "W1_top_tags", "N8_catalog_merge", "H7_bilingual_projection", "G1_hybrid_single",
            "G3_hard_only_single", "N11_batch_hybrid", "G3_batch_hard_only", "H8_serbian_normalizer",
            "H18_language_guard", "H21_flags_on_texts", "H14_structured_criteria", "N14_vector_reuse",
            "D8_bag_digest", "D8_tree_digest", "N19_release_compare", "W2_stratified_sample", "D11_compliance",
            "D14_ndcg_at_10", "D20_latency_percentiles", "K2_rejected_requests", "K3_usage_budgets"]


GROUPS = 32


def in_row_groups(sf_dir: str) -> str:
    """The tables with the same rows in more row groups: one group is read by one core, which no large table is."""
    out = Path(tempfile.mkdtemp(prefix="bench-"), Path(sf_dir).name)
    out.mkdir()
    for file in Path(sf_dir).glob("*.parquet"):
        table = pq.read_table(file)
        pq.write_table(table, out / file.name, row_group_size=max(1, -(-len(table) // GROUPS)))
    return str(out)


def main() -> None:
    sf_dir = in_row_groups(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))  # before any timing
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from filmloom.bindings import QUERIES
    from filmloom.session import build_session
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.sql.files.maxPartitionBytes": "8m",
        "spark.sql.files.openCostInBytes": "256k"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and not any(o in name for o in only):
            continue
        times = []
        for _ in range(2):  # the first run also compiles the generated code
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name} {times[0]:.2f} {times[1]:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
