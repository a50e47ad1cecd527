"""Benchmark the headline reports.

Runs every query once to warm up, then ``BENCH_RUNS`` (default 5) timed
rounds over all queries (interleaved),
and prints one JSON line with the median per query and their sum, plus the
rows each query returns, the core count, the Spark version and the settings
that shape the plans.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1),
``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 5), ``BENCH_SHUFFLE_PARTITIONS``
(default twice the cores; AQE coalesces small partitions).

Actions: aggregates and detail reports run to completion into Spark's
``noop`` sink (the whole plan executes, nothing is collected); the two
extracts are written as NDJSON under the checkpoint folder, which is what
they are for; paged reports collect their page. Row counts come from an
``Observation`` on the same job, so counting costs no extra pass.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from regsight.plans import catalog as C  # noqa: E402
from regsight.plans import reports as R  # noqa: E402
from regsight.session import build_session, scratch_path  # noqa: E402
from regsight.sources import export as X  # noqa: E402

PLAN_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                 "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold",
                 "spark.sql.optimizer.runtime.bloomFilter.enabled", "spark.sql.files.maxPartitionBytes")


def _setting(spark, key):
    try:
        return spark.conf.get(key)
    except Exception:  # noqa: BLE001 - a key without a default
        return None


def _observed(df):
    obs = Observation()
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def _noop(df) -> int:
    df, obs = _observed(df)
    df.write.format("noop").mode("overwrite").save()
    return int(obs.get["rows"])


def _collect(df) -> int:
    return len(df.collect())


def _export(spark, df, name) -> int:
    return int(X.export_with_summary(df, scratch_path(spark, name)).records)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus))))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=partitions,
                          app_name="regsight-bench")

    cases = {
        "q3_approved_submissions": lambda: _noop(C.q3(spark, sf_dir)),
        "q4_approved_submissions_by_year": lambda: _noop(C.q4(spark, sf_dir)),
        "q5_organisation_registration_summaries": lambda: _collect(C.q5(spark, sf_dir)),
        "q14_paycal_organisations": lambda: _export(
            spark, R.paycal_organisations(spark, sf_dir, C.RELATIVE_YEAR), "bench-q14"),
        "q15_paycal_poms": lambda: _export(
            spark, R.paycal_poms(spark, sf_dir, C.RELATIVE_YEAR), "bench-q15"),
        "q1_pom_summaries": lambda: _collect(C.q1(spark, sf_dir)),
        "q6_organisation_registration_detail": lambda: _noop(
            R.organisation_registration_detail(spark, sf_dir)),
        "q7_resubmission_pay_parameters": lambda: _noop(R.resubmission_pay_parameters(spark, sf_dir)),
        "q13_registration_fee_details": lambda: _noop(R.registration_fee_details(spark, sf_dir)),
        "q16_last_sync_time": lambda: _collect(R.last_sync_time(spark, sf_dir)),
    }
    # one warm-up pass over every query, then the timed runs interleaved
    # round-robin so that JVM warm-up and machine noise spread evenly
    for fn in cases.values():
        fn()
    times: dict[str, list[float]] = {name: [] for name in cases}
    rows = {}
    for _ in range(runs):
        for name, fn in cases.items():
            t0 = time.perf_counter()
            rows[name] = fn()
            times[name].append(time.perf_counter() - t0)
    medians = {name: round(statistics.median(ts), 4) for name, ts in times.items()}
    for name in cases:
        print(f"{name}: median {medians[name]:.3f}s over {runs} runs, {rows[name]} rows",
              file=sys.stderr)

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "headline_reports_total_median_sec",
        "value": round(sum(medians.values()), 4),
        "unit": "sec",
        "queries": medians,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "rows": rows,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
        "settings": {k: _setting(spark, k) for k in PLAN_SETTINGS},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
