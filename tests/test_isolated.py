import pytest
from pyspark.sql import functions as F

from cohortloom.plans.isolated import run_isolated


@pytest.fixture
def rows(spark):
    data = [("good", i, float(20 + i)) for i in range(6)] + [("broken", 1, 30.0), ("broken", 2, None), ("1", 1, 40.0)]
    return spark.createDataFrame(data, "dataset string, scan_id int, age double").repartition(3)


def mean_age(cohort):
    """Stops on executors at a missing age."""
    age = F.when(F.col("age").isNull(), F.raise_error(F.lit("scan without age"))).otherwise(F.col("age"))
    return cohort.groupBy("dataset").agg(F.avg(age).alias("mean_age"), F.count("*").alias("n"))


def by_name(status):
    return {r["dataset"]: r for r in status.collect()}


def test_a_broken_cohort_does_not_stop_the_others(rows):
    results, status = run_isolated(rows, ["good", "broken", "1", "absent", "good"], mean_age)
    assert {tuple(r) for r in results.collect()} == {("good", 22.5, 6), ("1", 40.0, 1)}
    found = by_name(status)
    assert set(found) == {"good", "broken", "1", "absent"} and status.count() == 4
    assert (found["good"]["status"], found["good"]["n_rows"], found["good"]["error"]) == ("ok", 1, None)
    assert (found["absent"]["status"], found["absent"]["n_rows"]) == ("ok", 0)
    assert found["broken"]["status"] == "failed" and found["broken"]["error"] and found["broken"]["n_rows"] == 0


def test_errors_of_the_plan_are_recorded(rows):
    def refuses(cohort):
        if cohort.isEmpty():
            raise ValueError("no scans\nat all")
        return cohort.select("scan_id")

    results, status = run_isolated(rows, ["absent", "good"], refuses, at_once=1)
    assert sorted(map(tuple, results.collect())) == [("good", i) for i in range(6)]
    assert tuple(by_name(status)["absent"]) == ("absent", "failed", "ValueError", "no scans", 0)
    assert run_isolated(rows, ["absent"], refuses)[0] is None


def test_a_job_reads_only_its_cohort(rows):
    plans = []

    def study(cohort):
        plans.append(cohort._jdf.queryExecution().executedPlan().toString())
        return cohort

    run_isolated(rows, ["good"], study)
    assert "PartitionFilters: [isnotnull(dataset" in plans[0]


def test_no_cohorts(rows):
    results, status = run_isolated(rows, [], mean_age)
    assert results is None and status.count() == 0
