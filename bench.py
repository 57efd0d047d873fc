"""Headline queries, timed: one JSON line.

Every phase of a batch run is timed as it runs in one: it reads the table the phase before has
written and its own result is computed in full (written to a sink that keeps nothing).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimflow.session import session  # noqa: E402
from workload import classify, decide, extract, ingest, stages  # noqa: E402

PHASES = {
    "phase_ingestion": stages.live_ingested,
    "phase_classification": stages.live_classified,
    "phase_extraction": stages.live_extracted,
    "phase_orchestration": stages.live_governed,
    "phase_agents": stages.live_decided,
}
QUERIES = {
    "assemble_ocr": ingest.assemble_ocr, "data_quality_rollup": ingest.data_quality_rollup,
    "rule_scores_prose": classify.rule_scores_prose, "documents_by_type": classify.documents_by_type,
    "redact_pii": extract.redact_pii, "parse_reply": extract.parse_reply_,
    "enrich_codes_table": extract.enrich_codes_table, "token_costs": extract.token_costs,
    "report_counts": decide.report_counts, "field_f1": decide.field_f1,
}


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    stages.decided(spark, sf_dir)  # the tables the phases read, also the warm-up
    times = {n: timed(lambda f=f: f(spark, sf_dir)) for n, f in {**PHASES, **QUERIES}.items()}
    rows = stages.ingested(spark, sf_dir).count()
    batch = sum(times[n] for n in PHASES)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "documents": rows,
        "documents_per_second_all_phases": round(rows / batch, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
