"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Feature queries are timed as one lazy plan each from the raw tables. Detector families and risk steps are timed as in
a pipeline run: on feature and finding tables that were written before, whose writing is timed as ``stage_*``.
"""

from __future__ import annotations

import json
import os
import time

from vigilframe import session
from vigilframe.operators import audit, forest, peers, validate
from vigilframe.plans import analysis, queries
from vigilframe.sources import fixture_views


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build_session(
        "vigilframe-bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
        },
    )
    timings: dict[str, float] = {}

    def timed(name: str, action) -> object:
        started = time.perf_counter()
        result = action()
        timings[name] = round(time.perf_counter() - started, 3)
        return result

    def run(name: str, build) -> None:
        timed(name, lambda: build().write.format("noop").mode("overwrite").save())

    spark.range(1000).selectExpr("sum(id)").collect()
    canonical = queries.canonical_tables(spark, sf_dir)
    lazy = queries.lazy_features(spark, sf_dir)
    for name in lazy:
        run(name, lambda name=name: lazy[name])
    faulty = fixture_views.faulty_tables(spark, canonical)
    run("validate_bundle", lambda: validate.bundle_issues(faulty))
    run("integrity_audit", lambda: audit.integrity_audit(canonical))

    tables = timed("stage_features", lambda: queries.bundle(spark, sf_dir))
    entities = tables["entity_features"]
    for phase, label in (("phase5", "rules"), ("phase6", "execution_gaps"), ("phase7", "negative_space")):
        run(f"{label}_findings", lambda phase=phase: analysis.FAMILIES[phase](tables).findings)
        run(f"{label}_evidence", lambda phase=phase: analysis.FAMILIES[phase](tables).evidence)
    run("peer_findings", lambda: analysis.evaluate_peers(tables, anomalies=False).findings)
    run("benchmark_table", lambda: peers.benchmark_table(entities))
    run("anomaly_findings", lambda: forest.anomaly_detection(entities).findings)
    timed("stage_findings", lambda: queries.detection(spark, sf_dir))
    timed("stage_risk", lambda: queries.risk(spark, sf_dir))
    run("risk_contributions", lambda: queries.risk(spark, sf_dir).contributions)
    run("entity_risk", lambda: queries.risk(spark, sf_dir).entity_risk)
    run("review_queue", lambda: queries.review_queue(spark, sf_dir))
    run("evidence_digest", lambda: queries.QUERIES["evidence_digest"](spark, sf_dir))
    run("commitment_verify", lambda: queries.QUERIES["commitment_verify"](spark, sf_dir))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
