import datetime

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import registry, scalars
from cohortloom.operators import describe, prepare, release, results, shift
from cohortloom.plans.catalog import QUERIES
from cohortloom.sources import metric_files, prepared


def test_session_key_keeps_long_days(spark):
    df = spark.createDataFrame([(7,), (1234,), (12345,)], "d int")
    assert [r[0] for r in df.select(scalars.session_key("d")).collect()] == ["d0007", "d1234", "d12345"]


def test_recode_passes_unlisted_values(spark):
    df = spark.createDataFrame([("1",), ("9",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.recode("s", {"1": "M"})).collect()] == ["M", "9", None]


def test_number_or_missing(spark):
    df = spark.createDataFrame([("3.5",), ("x",), ("nan",), ("inf",)], "s string")
    assert [r[0] for r in df.select(scalars.number_or_missing("s")).collect()] == [3.5, None, None, None]


def test_whole_column_cast(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x")], "a string, b string")
    assert prepare.cast_if_all(df, "a").schema["a"].dataType.simpleString() == "bigint"
    assert prepare.cast_if_all(df, "b").schema["b"].dataType.simpleString() == "string"


@pytest.mark.parametrize("name, status, canonical", [
    (" Cam-CAN ", "ok", "camcan"), ("OASIS-3", "ok", "oasis3"), ("../escaped", "invalid", None), ("unregistered", "unknown", None), ("", "invalid", None)])
def test_cohort_names(spark, name, status, canonical):
    df = spark.createDataFrame([(name,)], "n string")
    row = prepare.canonical_names(df, "n", list(registry.COHORTS), registry.COHORT_ALIASES).first()
    assert (row["status"], row["canonical"]) == (status, canonical)


def test_selection_violations(spark):
    df = spark.createDataFrame([("adni",), ("ADNI",), ("bad name",)], "n string")
    got = {(r["name"], r["reason"]) for r in prepare.selection_violations(df, "n", list(registry.COHORTS), registry.COHORT_ALIASES).collect()}
    assert got == {("adni", "repeated"), ("bad name", "invalid")}
    assert prepare.selection_violations(df.limit(0), "n", ["adni"], {}).first()["reason"] == "empty"


def test_proportional_sample_rounds_halves_to_even(spark):
    rows = [("Patient", i) for i in range(5)] + [("Control", i) for i in range(5, 15)]
    df = spark.createDataFrame(rows, "kind string, i int")
    got = prepare.proportional_first_rows(df, "kind", ["i"], 10).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"Patient": 3, "Control": 7}
    half = prepare.proportional_first_rows(df.where("i < 10"), "kind", ["i"], 5).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in half} == {"Patient": 2, "Control": 2}


def test_first_seen_file_and_listing(spark, tmp_path):
    for sub, ses, name in [("01", "a", "x2"), ("01", "a", "x1"), ("02", "b", "y")]:
        folder = tmp_path / f"sub-{sub}" / f"ses-{ses}" / "func"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"sub-{sub}_ses-{ses}_task-rest_{name}_bold.nii.gz").write_bytes(b"x")
    (tmp_path / "sub-02" / "other.txt").write_text("no")
    got = prepared.scan_catalogue(spark, str(tmp_path)).orderBy("SubjectID")
    rows = got.collect()
    assert [(r["SubjectID"], r["Session"], r["path"].rsplit("/", 1)[1]) for r in rows] == [
        ("01", "a", "sub-01_ses-a_task-rest_x1_bold.nii.gz"), ("02", "b", "sub-02_ses-b_task-rest_y_bold.nii.gz")]
    assert prepared.scan_catalogue(spark, str(tmp_path), first_n=1).count() == 1
    assert "content" not in prepared.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def cohort_table(spark, names=("cobre", "adni")):
    rows = [(d, s, 20.0 + k, [[1.0, 2.0], [3.0, 4.0]]) for d in names for k, s in enumerate(["1", "2"])]
    return spark.createDataFrame(rows, "dataset string, SubjectID string, Age double, TimeSeries array<array<double>>")


def test_prepared_tables(spark, tmp_path):
    root = str(tmp_path / "prepared")
    assert prepared.missing_cohorts(spark, root, "msdl_39", ["adni"]) == ["adni"]
    assert prepared.write_prepared(cohort_table(spark), root, "msdl") == ["adni", "cobre"]
    changed = cohort_table(spark).withColumn("Age", F.lit(99.0))
    assert prepared.write_prepared(changed, root, "msdl_39") == []
    assert prepared.read_cohort(spark, root, "msdl39", "cobre").agg(F.max("Age")).first()[0] == 21.0
    assert prepared.write_prepared(changed.where("dataset = 'adni'"), root, "msdl", rebuild=True) == ["adni"]
    pooled = prepared.read_pooled(spark, root, "msdl", ["ADNI", "cobre"])
    assert sorted(r["subject"] for r in pooled.collect()) == ["adni_1", "adni_2", "cobre_1", "cobre_2"]
    assert {r["dataset"]: r["a"] for r in pooled.groupBy("dataset").agg(F.max("Age").alias("a")).collect()} == {"adni": 99.0, "cobre": 21.0}
    plan = prepared.read_cohort(spark, root, "msdl", "cobre")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cobre" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert prepared.read_pooled(spark, root, "msdl", ["adni", "cobre"], debug=1).count() == 2
    with pytest.raises(FileNotFoundError):
        prepared.read_cohort(spark, root, "msdl", "abide")
    with pytest.raises(ValueError):
        prepared.read_cohort(spark, root, "msdl", "../escaped")
    with pytest.raises(ValueError):
        prepared.read_pooled(spark, root, "msdl", ["adni", "ADNI"])
    with pytest.raises(ValueError, match="Score"):
        prepared.read_cohort(spark, root, "msdl", "adni", target="Score")
    blank = cohort_table(spark, ("abide",)).withColumn("SubjectID", F.lit("  "))
    prepared.write_prepared(blank, root, "msdl")
    with pytest.raises(Exception, match="empty SubjectID"):
        prepared.read_cohort(spark, root, "msdl", "abide").collect()


def test_phenotype_files(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("a\tb c\n007\t31.5\n008\tx\n")
    table = prepared.read_phenotype(spark, str(path), "id string, `Current Age` string", sep="\t", names=["ID", "Current Age"])
    assert table.columns == ["id", "current_age"] and [r["id"] for r in table.collect()] == ["007", "008"]


NAMES = ["[2026-04-18 16:46:01]ALL-a-b_SPDNet_AgeReg_epochs100_LODO.csv", "[2026-04-22_20-42-51]ALL-a-b_SPDNet_AgeReg_epochs100_LODO.csv",
         "[2026-04-22_20-42-51]ALL-a-b_CorrVec_Ridge_AgeReg_LODO_harm.csv", "[2026-04-18 16:46:01]ALL-a-b_Ridge_AgeReg_TS_riemann_GKF5.csv",
         "SPDNet_AgeReg_LODO.csv", "[2026-13-99 16:46:01]ALL-a_SPDNet_AgeReg_LODO.csv"]


def test_latest_pooled_runs(spark):
    files = spark.createDataFrame([(n,) for n in NAMES], "file_name string")
    got = {(r["model"], r["experiment"], r["harmonized"]): r["file_name"] for r in results.latest_pooled_runs(files).collect()}
    assert got == {("SPDNet", "LODO", False): NAMES[1], ("VecCorrRidge", "LODO", True): NAMES[2], ("Ridge", "GKF5", False): NAMES[3]}


def test_single_runs_accept_legacy_names(spark):
    names = ["[2026-01-01 00:00:00]adni_CorrVec_Ridge_AgeReg.csv", "[2026-01-02 00:00:00]adni_Ridge_AgeReg_VecCorr.csv",
             "[2026-01-03 00:00:00]adnidod_Dummy_AgeReg_mean.csv"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    cover = {(r["dataset"], r["model"]): r["file_name"] for r in results.run_coverage(files, ["adni", "adnidod"]).collect()}
    assert cover[("adni", "VecCorrRidge")] == names[1] and cover[("adnidod", "Dummy")] == names[2] and cover[("adni", "Dummy")] is None


def test_metric_files_round_trip(spark, tmp_path):
    # local Hadoop file systems cannot open names with a colon, so both files use the dashed time style
    folder = tmp_path / "runs"
    folder.mkdir()
    kfold = NAMES[3].replace("2026-04-18 16:46:01", "2026-04-18_16-46-01")
    (folder / NAMES[1]).write_text(",TEST_a,TEST_b,Avg,Time(sec)\nMAE,1.0,3.0,2.0,9\nR2,0.5,,0.5,9\n\"corr(BAG,age)\",0.1,nan,0.1,9\n")
    (folder / kfold).write_text(",R1,R2,Avg,Time(sec)\nMAE,4.0,6.0,5.0,9\n")
    archive = metric_files.read_archive(spark, str(folder))
    assert archive.where("metric = 'MAE'").count() == 8
    assert {r["fold"]: r["value"] for r in archive.where("metric = 'corr(BAG,age)'").collect()}["TEST_b"] is None
    points = metric_files.metric_points(archive.where(F.col("file_name").contains("LODO")), "MAE", "TEST_")
    assert sorted(r["value"] for r in points.collect()) == [1.0, 3.0]
    with pytest.raises(Exception, match="no R2 with R folds"):
        metric_files.metric_points(archive, "R2", "R").collect()
    averages = {r["file_name"]: r["Avg"] for r in results.file_average(archive, "MAE").collect()}
    assert averages == {NAMES[1]: 2.0, kfold: 5.0}
    long = results.lodo_long(archive)
    assert {r["held_out_dataset"] for r in long.where("model = 'SPDNet' AND harmonization = 'original'").collect()} == {"a", "b"}


def test_every_lodo_file_is_kept_and_repeats_are_refused(spark):
    names = ["[2026-04-18 16:46:01]ALL_SPDNet_LODO.csv", "[2026-05-18 16:46:01]ALL_SPDNet_LODO.csv", "ALL_SPDNet_LODO.csv"]
    archive = spark.createDataFrame(
        [(n, "MAE", "TEST_a", float(i)) for i, n in enumerate(names)], "file_name string, metric string, fold string, value double")
    long = results.lodo_long(archive)
    assert sorted(r["MAE"] for r in long.collect()) == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="several rows for a"):
        results.lodo_wide(long).collect()
    assert results.lodo_wide(results.newest_lodo(long)).first()["MAE|SPDNet|original"] == 1.0


def test_average_skips_folds_without_a_finite_value(spark):
    long = spark.createDataFrame([("MAE", "R1", float("nan")), ("MAE", "R2", 1.0), ("MAE", "R3", None)],
                                 "metric string, fold string, value double")
    assert results.wide_metrics(long, ["R1", "R2", "R3"]).first()["Avg"] == 1.0


def test_unequal_row_keys_stop_or_are_reported(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_key int, v string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "row_key int, w int")
    with pytest.raises(Exception, match="row key of one side only"):
        prepare.joined_by_row_key(a, b, "row_key").collect()
    found = {r["row_key"]: r["missing"] for r in prepare.joined_by_row_key(a, b, "row_key", report=True).collect()}
    assert found == {1: "right", 2: None, 3: "left"}


def test_no_key_and_no_nation_is_left_out_of_the_whole_queries(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = datetime.date(1995, 3, 4)
    write("customer", [(k, f"c{k}", k % 25, "BUILDING") for k in range(1, 41) if k != 24],
          "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")
    write("orders", [(k, day) for k in range(2, 43)], "o_custkey long, o_orderdate date")
    write("nation", [(k, f"N{k}") for k in range(25)], "n_nationkey long, n_name string")
    write("region", [(0, "R0")], "r_regionkey long, r_name string")
    keys = {r["row_key"]: r["missing"] for r in QUERIES["row_key_concat_whole"](spark, str(tmp_path)).collect()}
    assert keys == {**dict.fromkeys(range(1, 43)), 1: "right", 24: "left", 41: "left", 42: "left"}
    cover = QUERIES["run_coverage_whole"](spark, str(tmp_path)).where("model = 'Dummy' AND missing").collect()
    assert {r["dataset"] for r in cover} == {"N24", "R0"}


def test_coverage_of_many_cohorts(spark):
    files = spark.createDataFrame([(f"[2026-04-18 16:46:01]c_{i}_Dummy_AgeReg_mean.csv",) for i in range(1500)], "file_name string")
    cohorts = spark.range(1500).selectExpr("concat('C_', id) AS dataset")
    found = results.run_coverage(files, cohorts)
    assert found.count() == 6000 and found.where("model = 'Dummy' AND missing").count() == 0


def test_metric_file_of_many_columns_is_read_whole(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(["", *[f"R{i}" for i in range(3000)]]) + "\nMAE" + ",1.0" * 3000 + "\n")
    assert metric_files.read_archive(spark, str(tmp_path)).count() == 3000


def test_any_absolute_path_and_any_custom_pattern_are_found(spark):
    texts = spark.createDataFrame(
        [(1, "see /work/a/b and (/nfs/x/y)"), (2, "<p>and/or</p> http://host/a 1/2"), (3, "code XY-77")], "id int, text string")
    found = release.privacy_findings(texts, ["id"], custom={"CODE": r"XY-\d+"}).collect()
    assert sorted((r["id"], r["code"]) for r in found) == [(1, "ABSOLUTE_POSIX_PATH")] * 2 + [(3, "CODE")]


def test_wide_writer_checks_fold_counts(spark, tmp_path):
    long = spark.createDataFrame([("MAE", "R1", 1.0), ("MAE", "R2", 2.0)], "metric string, fold string, value double")
    table = metric_files.write_wide(long, ["R1", "R2"], str(tmp_path / "m"), 3.0, strict=True)
    assert table.first()["Avg"] == 1.5
    with pytest.raises(ValueError, match="expected 3"):
        metric_files.write_wide(long, ["R1", "R2", "R3"], str(tmp_path / "n"), 3.0, strict=True)
    back = metric_files.read_archive(spark, str(tmp_path / "m"))
    assert {r["fold"]: r["value"] for r in back.collect()}["Avg"] == 1.5


def test_aggregate_outputs_hold_no_identifiers(spark, tmp_path):
    table = spark.createDataFrame([("a", 1)], "dataset string, n int")
    metric_files.write_small_table(table, str(tmp_path / "t"), ["dataset"])
    with pytest.raises(ValueError, match="subject_id"):
        metric_files.write_small_table(table.withColumnRenamed("n", "subject_id"), str(tmp_path / "u"), ["dataset"])
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.csv").write_text("a\n")
    metric_files.refuse_identifier_outputs(spark, str(tmp_path / "out"))
    (tmp_path / "out" / "subject_level_table.csv").write_text("a\n")
    with pytest.raises(ValueError, match="identifier-level"):
        metric_files.refuse_identifier_outputs(spark, str(tmp_path / "out"))


def test_extrema_ties_follow_model_order(spark):
    long = spark.createDataFrame([
        ("a", "Ridge", "original", 1.0, 0.5, None, -0.5), ("a", "CorrVec", "harmonized", 1.0, 0.5, None, 0.5),
        ("a", "Dummy", "original", 2.0, -1.0, None, -1.0)],
        "held_out_dataset string, model string, harmonization string, MAE double, R_squared double, Spearman_rank_correlation double, age_bias_slope double")
    row = results.lodo_extrema(long).first()
    assert row["lowest_MAE_model"] == row["highest_R2_model"] == "CorrVec (harmonized)"
    assert row["highest_Spearman_model"] is None
    assert (row["largest_abs_age_bias_slope_model"], row["largest_abs_age_bias_slope"]) == ("Dummy (original)", -1.0)


def test_display_labels(spark):
    df = spark.createDataFrame([("VecCorrRidge (harmonization)",), ("Ridge (original)",), ("SPDNet(harmonization)",), ("Dummy",)], "m string")
    assert [r[0] for r in df.select(scalars.display_model("m")).collect()] == ["CorrVec$^{*}$", "TS Ridge", "SPDNet$^{*}$", "Dummy"]


def test_baseline_caption(spark):
    points = spark.createDataFrame([("L", 1.0), ("L", 3.0), ("G", None)], "experiment string, value double")
    got = {r["experiment"]: r["caption"] for r in results.baseline_summary(points, ["experiment"]).collect()}
    assert got == {"L": "Dummy mean=2.00, std=1.00", "G": "Dummy: undefined"}


def test_diagnosis_labels_per_cohort(spark):
    rows = [("oasis3", "0.5"), ("oasis3", None), ("cobre", "1"), ("adni", "MCI")]
    df = spark.createDataFrame(rows, "dataset string, diagnosis string")
    got = {(r["dataset"], r["label"]): r["fraction"] for r in describe.category_fractions(df, "diagnosis", maps=registry.DIAGNOSIS_LABELS).collect()}
    assert got == {("oasis3", "CDR 0.5: very mild impairment"): 0.5, ("oasis3", "missing"): 0.5, ("cobre", "schizophrenia"): 1.0, ("adni", "MCI"): 1.0}


def test_diagnosis_order(spark):
    df = spark.createDataFrame([(x,) for x in ("control", "AD", "zz", "missing", "CN", "ASD")], "label string")
    assert [r["label"] for r in shift.diagnosis_order(df).orderBy("position").collect()] == ["CN", "AD", "control", "ASD", "zz"]


def test_privacy_texts(spark):
    texts = [(1, "Do not publish /Users/private-reviewer/source/sub-secret01/file.txt\n"), (2, "<details>\n<summary>Notes</summary>\n</details>\n"),
             (3, "email: synthetic.author@example.org"), (4, "sourcedata/internal.csv"), (5, "marker-123"), (6, "C:\\Users\\x\\y.txt")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = release.privacy_findings(df, ["id"], custom={"MARK": r"(marker-\d+)"}, allowed_emails=["Synthetic.Author@example.org"]).toPandas()
    assert set(zip(got["id"], got["code"])) == {(1, "ABSOLUTE_POSIX_PATH"), (1, "BIDS_PARTICIPANT_IDENTIFIER"), (4, "RELATIVE_SOURCE_PATH"), (5, "MARK"), (6, "ABSOLUTE_WINDOWS_PATH")}
    assert not any("secret" in str(v) for v in got.to_numpy().ravel())
    assert release.privacy_findings(df.where("id = 3"), ["id"]).first()["code"] == "EMAIL_ADDRESS"


@pytest.mark.parametrize("column", ["home_interview_score", "questionnaire_response", "survey_item_1", "behavioral_measure",
                                    "behavioural_variables", "comments", "unrestricted_clinical_text", "raw_filename", "CCID", "subject_id"])
def test_forbidden_columns_beat_the_allow_list(spark, column):
    df = spark.createDataFrame([(column,), ("age",)], "c string")
    assert [tuple(r) for r in release.column_findings(df, "c", ["age", column]).collect()] == [(column, "FORBIDDEN_METADATA_COLUMN")]


def test_file_names(spark):
    df = spark.createDataFrame([("participant_T1w.dicom",), ("a/synthetic.pkl",), ("tables/ok.csv",)], "path string")
    got = {(r["path"], r["code"]) for r in release.file_findings(df).collect()}
    assert got == {("participant_T1w.dicom", "FORBIDDEN_FILE_EXTENSION"), ("participant_T1w.dicom", "RAW_T1_IMAGE"), ("a/synthetic.pkl", "SOURCE_PICKLE_NAME")}


def test_public_ids(spark):
    df = spark.createDataFrame([("s" + "0" * 31 + "1",), ("cc110033",), (None,)], "uid string")
    assert release.bad_public_ids(df, "uid").count() == 2


def test_checksums_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha\n")
    (tmp_path / "b.txt").write_text("beta\n")
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    listed = release.checksum_catalogue(files).collect()
    import hashlib

    assert {r["path"]: r["sha256"] for r in listed} == {"a.txt": hashlib.sha256(b"alpha\n").hexdigest(), "b.txt": hashlib.sha256(b"beta\n").hexdigest()}
    frame = spark.createDataFrame(listed)
    assert release.checksum_findings(frame, frame).count() == 0


def test_plain_queries_push_filters_and_prune_columns(spark, folder):
    from cohortloom.plans.catalog import QUERIES

    plan = QUERIES["required_input_audit"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan
    gap = QUERIES["lodo_mean_gap"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in gap and "CartesianProduct" not in gap and "NestedLoop" not in gap


def test_diagnosis_order_of_each_cohort(spark):
    rows = [("Adni", x) for x in ("AD", "missing", "CN", "odd", "AD", None)] + [
        ("oasis3", x) for x in ("missing", "CDR 2: moderate dementia", "CDR 0: cognitively normal", "a")] + [
        ("cobre", x) for x in ("schizophrenia", "control", "missing", "zzz")] + [(None, "MCI")]
    got = shift.diagnosis_order_by_cohort(spark.createDataFrame(rows, "dataset string, label string")).collect()
    order = {}
    for r in sorted(got, key=lambda r: r["position"]):
        order.setdefault(r["dataset"], []).append((r["label"], r["shown"]))
    assert [x for x, _ in order["Adni"]] == ["CN", "AD", "missing", "odd"]
    assert order["oasis3"] == [("CDR 0: cognitively normal", "cognitively\nnormal"), ("CDR 2: moderate dementia", "moderate"), ("a", "a")]
    assert [x for x, _ in order["cobre"]] == ["control", "schizophrenia", "zzz"] and order[None] == [("MCI", "MCI")]
