"""Hot groups: largest task of W2 and J2, plain form vs split form.

Derives a skewed submissions table from the driver tables (a third of all
submissions remapped onto one organisation and year), then reports the
rows of the largest window task for a plain ``partitionBy(org, year)``
window and for W2's split path, and whether both give the same flags.
usage: python tools/skew_check.py [sf_dir] [tasks]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from regsight.operators import joins as J  # noqa: E402
from regsight.operators import paging as W  # noqa: E402
from regsight.session import build_session  # noqa: E402
from regsight.sources import standin as V  # noqa: E402

GROUP, ORDER = ["organisation_id", "submission_year"], ["submitted_at", "submission_id"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    tasks = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    spark = build_session(shuffle_partitions=tasks)
    hot = F.col("submission_id") % 3 == 0
    subs = (V.submissions(spark, sf_dir)
            .withColumn("organisation_id", F.when(hot, F.lit(0)).otherwise(F.col("organisation_id")))
            .withColumn("submission_year", F.when(hot, F.lit(2025)).otherwise(F.col("submission_year"))))
    total = subs.count()

    def largest_task(df):
        return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

    plain_max = largest_task(subs.repartition(tasks, *GROUP))
    split_max = largest_task(subs.repartitionByRange(tasks, *GROUP, *ORDER))

    w = Window.partitionBy(*GROUP).orderBy(*ORDER)
    rc = F.when(F.col("status") == "Rejected", F.col("comments"))
    plain = subs.select("submission_id", (F.row_number().over(w) > 1).alias("r"),
                        F.lag(rc).over(w).alias("c"))
    split = W.resubmission_history(subs, GROUP, ORDER, "status", "comments",
                                   hot_rows=total // (2 * tasks)) \
        .select("submission_id", F.col("is_resubmission").alias("r"),
                F.col("previous_rejection_comments").alias("c"))
    differing = plain.exceptAll(split).count() + split.exceptAll(plain).count()

    # J2 under the same hot organisation: a shuffle join hashes the organisation
    # key, so the hot key lands in one task; the split join shuffles only the
    # cold rows and joins the hot ones against a broadcast where they are.
    orgs = V.organisations(spark, sf_dir).select("organisation_id", "organisation_name")
    hot_keys = subs.groupBy("organisation_id").count().filter(F.col("count") > total // (2 * tasks))
    # input splits are balanced by bytes, whatever the keys: model them round-robin
    scan = subs.repartition(tasks)
    cold_subs = scan.join(hot_keys.select("organisation_id"), "organisation_id", "left_anti")
    join_plain_max = largest_task(scan.repartition(tasks, "organisation_id"))
    join_split_max = max(largest_task(cold_subs.repartition(tasks, "organisation_id")),
                         largest_task(scan.filter(hot)))
    plain_join = subs.join(orgs, "organisation_id").select("submission_id", "organisation_name")
    split_join = J.split_hot_join(subs, orgs, "organisation_id", "inner",
                                  hot_rows=total // (2 * tasks)) \
        .select("submission_id", "organisation_name")
    join_differing = plain_join.exceptAll(split_join).count() + split_join.exceptAll(plain_join).count()
    print(json.dumps({"sf_dir": sf_dir, "rows": total, "tasks": tasks,
                      "hot_group_rows": subs.filter(hot).count(),
                      "plain_window_largest_task_rows": plain_max,
                      "split_path_largest_task_rows": split_max,
                      "differing_rows": differing,
                      "join_shuffle_largest_task_rows": join_plain_max,
                      "join_split_largest_task_rows": join_split_max,
                      "join_differing_rows": join_differing}))


if __name__ == "__main__":
    main()
