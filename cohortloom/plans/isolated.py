"""One job per cohort: a cohort that fails is recorded, the others go on."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage, shared_folder

STATUS = "dataset string, status string, error string, message string, n_rows bigint"


def run_isolated(rows: DataFrame, cohorts: Sequence[str], study: Callable[[DataFrame], DataFrame],
                 dataset: str = "dataset", at_once: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """Run ``study`` on the rows of each cohort by itself: (results of those that finished, status of all).

    The rows are written once, partitioned by cohort, so a job opens only the files of its own cohort. Each job has
    its own job group, named after the cohort, and ``at_once`` of them share the cluster. Whatever stops a job, while its
    plan is made or while it runs, ends up in its status row (dataset, status, error, message, n_rows) and does not reach
    the others. Cohorts without rows get an empty table; whether that is an error is the study's decision. Names
    given twice run once. The results are tables already written, with the cohort as first column; there are none
    (None) if no cohort finished.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/cohortloom-{uuid.uuid4().hex}"
    rows.write.partitionBy(dataset).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)

    def job(name: str) -> tuple[DataFrame | None, tuple]:
        spark.sparkContext.setJobGroup(f"cohort-{name}", f"study of {name}")
        try:
            totals = Observation()
            own = study(written.where(F.col(dataset) == name)).drop(dataset)
            table = cut_lineage(own.observe(totals, F.count(F.lit(1)).alias("n")))
            found = totals.get.get("n", 0)
        except Exception as error:  # any failure of one cohort is its result
            first = (str(error).strip().splitlines() or [""])[0]
            return None, (name, "failed", type(error).__name__, first[:500], 0)
        return table.select(F.lit(name).alias(dataset), *table.columns), (name, "ok", None, None, found)

    names = list(dict.fromkeys(cohorts))
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(functools.partial(job, name))) for name in names]
        done = [one.result() for one in started]
    tables = [table for table, _ in done if table is not None]
    results = functools.reduce(DataFrame.unionByName, tables) if tables else None
    return results, spark.createDataFrame([status for _, status in done], STATUS)
