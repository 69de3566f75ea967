"""Delimited reading, landing, events, registry and the prepare facade."""

import time

import pytest
from pyspark.sql import functions as F

from tablesmith.facade import prepare, run_features, run_validation
from tablesmith.sources import registry
from tablesmith.sources.artifacts import (
    profile_documents, profiles_from_documents, read_artifacts, transform_log, write_features, write_pairs, write_table,
)
from tablesmith.sources.delimited import file_type, header_names, promote_header, read_delimited
from tablesmith.sources.events import (
    RunLog, event, filter_events, log_events, make_run_id, read_events, stage_states, step_durations,
)
from tablesmith.sources.tables import list_files, read_excel, read_table, resolve_source
from tablesmith.streaming.landing import ingest, ingest_folder, ingest_stream, read_metadata, read_raw


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types_and_missing_tokens(spark, tmp_path):
    f = write(tmp_path / "a.csv", "id,x,flag,name\n1,2.5,True,ann\n2,NA,False,n/a\n3,,true,NULL\n")
    df, info = read_delimited(spark, f)
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("flag", "boolean"), ("name", "string")]
    assert rows(df) == [(1, 2.5, True, "ann"), (2, None, False, None), (3, None, True, None)]
    assert (info.encoding, info.separator, info.columns_read) == ("utf-8", "comma", 4)


def test_semicolon_file_by_every_detecting_strategy(spark, tmp_path):
    f = write(tmp_path / "cardio.csv", "id;age;gender\n1;50;NA\n2;61;1\n")
    for strategy in ("sniff", "first_line", "schema_match", "first_multicolumn"):
        df, info = read_delimited(spark, f, strategy, ["id", "age", "gender"])
        assert df.columns == ["id", "age", "gender"], strategy
        assert info.separator == "semicolon"
        assert rows(df) == [(1, 50, None), (2, 61, 1)]
    df, info = read_delimited(spark, f, "schema_match", ["id", "age", "gender"])
    assert info.schema_match_score == 30
    assert len(read_delimited(spark, f, "encoding_only")[0].columns) == 1


def test_tab_and_pipe_by_expected_columns(spark, tmp_path):
    for name, sep in (("tab", "\t"), ("pipe", "|")):
        f = write(tmp_path / f"{name}.csv", sep.join("abc") + "\n" + sep.join("123") + "\n")
        df, info = read_delimited(spark, f, "schema_match", ["a", "b", "c"])
        assert (info.separator, rows(df)) == (name, [(1, 2, 3)])


def test_long_rows_dropped_short_rows_padded(spark, tmp_path):
    f = write(tmp_path / "bad.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,3\n1,2,3,\n7,"q ""w"", e",8\n')
    df, _ = read_delimited(spark, f)
    assert rows(df) == [("1", "2", 3), ("4", "5", None), ("x,y", "2", 3), ("7", 'q "w", e', 8)]
    assert df.select("c").count() == 4  # same rows when only one column is read


def test_encodings(spark, tmp_path):
    latin = write(tmp_path / "l.csv", "name,n\ncafé,1\n", "latin-1")
    assert rows(read_delimited(spark, latin)[0]) == [("café", 1)]
    euro = write(tmp_path / "e.csv", "name\n5 € – “x”\n", "cp1252")
    assert rows(read_delimited(spark, euro)[0]) == [("5 € – “x”",)]
    assert read_delimited(spark, latin)[1].encoding == "cp1252"
    assert read_delimited(spark, latin, "first_line")[1].encoding == "latin-1"
    odd = tmp_path / "odd.csv"
    odd.write_bytes(b"name,n\na\x81b,1\n")
    assert read_delimited(spark, str(odd))[1].encoding == "latin1"
    bom = write(tmp_path / "b.csv", "﻿k,v\n1,2\n")
    assert read_delimited(spark, bom)[0].columns == ["k", "v"]


def test_header_names_and_file_types():
    assert header_names("a,,a,b", ",") == ["a", "Unnamed: 1", "a.1", "b"]
    assert file_type("x/y.CSV") == ".csv"
    with pytest.raises(ValueError):
        file_type("x.parquet")


def test_excel_needs_its_package(spark, tmp_path):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(NotImplementedError):
            read_excel(spark, str(tmp_path / "x.xlsx"))


def test_promote_header(spark):
    df = spark.createDataFrame([(0, "title id", " year "), (1, "tt1", "1999")], "p long, a string, b string")
    data = df.drop("p")
    out = promote_header(df.select("a", "b", "p").drop("p"), F.monotonically_increasing_id())
    assert out.columns == ["title id", "year"] and rows(out) == [("tt1", "1999")]
    numbers = spark.createDataFrame([("1", "2")], "a string, b string")
    assert promote_header(numbers, F.monotonically_increasing_id()).columns == data.columns


def test_resolve_source_and_listing(spark, tmp_path):
    raw = write(tmp_path / "d.csv", "a;b\n1;2\n")
    narrow = write(tmp_path / "d_cleaned.csv", "only\n1\n")
    assert resolve_source(spark, narrow, raw).columns == ["a", "b"]
    wide = write(tmp_path / "e_cleaned.csv", "a,b\n1,2\n")
    assert rows(resolve_source(spark, wide, raw)) == [(1, 2)]
    assert resolve_source(spark, str(tmp_path / "no.csv"), str(tmp_path / "none.csv")) is None
    assert list_files(spark, str(tmp_path / "*_cleaned.csv")).count() == 2
    assert read_table(spark, raw)[0].columns == ["a", "b"]


def test_landing_is_repeatable_and_logs_failures(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    write(inbox / "one.csv", "a,b\n1,2\n3,4\n")
    write(inbox / "empty.csv", "")
    write(inbox / "notes.txt", "no")
    got = {r["file"]: r["status"] for r in ingest_folder(spark, str(inbox), root).collect()}
    assert got == {"one.csv": "completed", "empty.csv": "failed"}
    again, _ = ingest(spark, str(inbox / "one.csv"), root)
    meta = read_metadata(spark, root).collect()
    assert len(meta) == 1 and meta[0]["rows"] == 2 and meta[0]["columns"] == ["a", "b"]
    assert again.first()["version_id"] == meta[0]["version_id"]
    landed = read_raw(spark, root, "one", meta[0]["version_id"])
    assert landed.columns == ["a", "b", "_row_id"] and landed.count() == 2
    log = read_events(spark, f"{root}/events")
    assert filter_events(log, step="ingestion", status="failed").count() == 1


def test_stream_lands_each_file_once(spark, tmp_path):
    inbox, root, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()
    write(inbox / "a.csv", "a,b\n1,2\n")
    ingest_stream(spark, str(inbox), root, checkpoint=ck).awaitTermination(120)
    write(inbox / "b.csv", "a,b\n1,2\n")
    write(inbox / "skip.txt", "x")
    ingest_stream(spark, str(inbox), root, checkpoint=ck).awaitTermination(120)
    done = read_events(spark, f"{root}/events")
    assert sorted(r[0] for r in done.select("dataset_name").collect()) == ["a", "b"]
    assert read_metadata(spark, root).count() == 2


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_events(spark, path).count() == 0
    run = make_run_id(spark)
    log_events(event(spark, run, "validation", "completed", 12, "d", "v", None, {"rows": 3}), path)
    log_events(event(spark, run, "validation", "failed", 1, error_detail="boom"), path)
    assert filter_events(read_events(spark, path), run_id=run, status="failed").first()["error_detail"] == "boom"
    assert filter_events(read_events(spark, path), status="completed").first()["details"] == {"rows": "3"}


def test_registry_round_trip(spark, tmp_path):
    root = str(tmp_path / "reg")
    assert registry.read(spark, root, "runs").count() == 0
    row = spark.createDataFrame([("r1", "d1", "started")], "run_id string, dataset_id string, status string")
    registry.append(row, root, "runs")
    assert registry.lookup(registry.read(spark, root, "runs"), run_id="r1").first()["status"] == "started"
    with pytest.raises(Exception, match="invalid status"):
        registry.append(row.withColumn("status", F.lit("odd")), root, "runs")
    with pytest.raises(ValueError):
        registry.append(row.withColumn("zz", F.lit(1)), root, "runs")
    with pytest.raises(ValueError):
        registry.check_limit(0)
    registry.append(registry.manual_plan(spark, "d1", "{}", "y", "classification"), root, "plans")
    assert registry.read(spark, root, "plans").first()["plan_source"] == "manual"
    metric = spark.createDataFrame([("m", "r1", 0.5)], "metric_id string, run_id string, accuracy double")
    registry.append(metric, root, "metrics")
    assert registry.read(spark, root, "metrics").first()["accuracy"] == 0.5


def test_plan_files_and_artifacts(spark, tmp_path):
    write(tmp_path / "20240101_000000_0a1b2c3d_x_plan.json", '{"target_column": "y", "task_type": "regression"}')
    write(tmp_path / "broken_plan.json", '{"target_column": ')
    plans = registry.plans_from_files(spark, str(tmp_path / "*_plan.json"))
    assert [(r["dataset_id"], r["target_column"]) for r in plans.collect()] == [("20240101_000000_0a1b2c3d_x", "y")]
    got = {r["file_name"]: r["json"] for r in read_artifacts(spark, str(tmp_path / "*.json")).collect()}
    assert got["broken_plan.json"] is None and len(got) == 2
    assert read_artifacts(spark, str(tmp_path / "none/*.json")).count() == 0


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "train"), (2, 'q"z', "test")], "n int, t string, split string")
    write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'test'").count() == 1
    write_table(df, str(tmp_path / "c"), "csv")
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "c"))
    assert sorted(r["t"] for r in back.collect()) == ["a\nb", 'q"z']
    write_pairs(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/jsonl")).count() == 2
    assert transform_log(df, "n", "utf-8", 2).first()["final_shape"] == [2, 3]


def test_prepare_end_to_end(spark, tmp_path):
    lines = ["PassengerId,Age,Fare,Sex,Survived"]
    lines += [f"{i},{20 + i % 40},{i * 1.5},{'m' if i % 3 else 'f'},{i % 2}" for i in range(1, 61)]
    lines += ["61,,9.5,m,1"]
    f = write(tmp_path / "titanic.csv", "\n".join(lines) + "\n")
    root = str(tmp_path / "out")
    got = prepare(spark, f, root)
    plan = got.plan.first()
    assert plan["target_column"] == "Survived" and plan["task_type"] == "classification"
    assert plan["drop_columns"] == ["PassengerId", "Fare"] or plan["drop_columns"] == ["PassengerId"]
    assert got.validation.first()["is_valid"]
    meta = got.meta.first()
    assert (meta["target_column"], meta["target_detection_method"]) == ("Survived", "exact_keyword")
    assert meta["total_missing_values"] == 1
    by = {r["name"]: r for r in got.profile.collect()}
    assert by["Age"]["dtype"] == "float64" and by["PassengerId"]["dtype"] == "int64"
    assert by["Sex"]["sample_values"] == ["m", "f"]
    docs = profile_documents(got.profile, got.meta)
    cols, back = profiles_from_documents(docs)
    assert [r["name"] for r in cols.orderBy("ordinal").collect()] == lines[0].split(",")
    assert back.first()["target_column"] == "Survived"
    assert registry.read(spark, f"{root}/registry", "runs").first()["status"] == "success"
    override = prepare(spark, f, root, target="Sex")
    assert override.rules.first()["target_column"] == "Sex"


def test_line_breaks_headers_and_names(spark, tmp_path):
    from tablesmith.sources.delimited import read_delimited

    one = tmp_path / "quoted.csv"
    one.write_text('id,text,n\n1,"a\nb",5\n2,"c ""d""",6\n3,e,7,8\n')
    rows = [tuple(r) for r in read_delimited(spark, str(one))[0].collect()]
    assert sorted(rows) == [(1, "a\nb", 5), (2, 'c "d"', 6)]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n3,4\n")
    got = read_delimited(spark, str(folder))[0]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 2), (4, 3)]
    case = tmp_path / "case.csv"
    case.write_text("A,a\n1,2\n")
    assert read_delimited(spark, str(case))[0].columns == ["A", "a.1"]


def test_registry_keeps_one_row_for_each_key(spark, tmp_path):
    root = str(tmp_path)
    for n, at in ((1, "2024-01-01"), (2, "2024-01-02"), (3, None)):
        registry.append(spark.createDataFrame([("d", "data", n)], "dataset_id string, dataset_name string, row_count long").withColumn(
            "updated_at", F.lit(at).cast("timestamp")), root, "datasets")
    registry.append(spark.createDataFrame([("r", "d", "p", "success")], "run_id string, dataset_id string, plan_id string, status string").withColumn(
        "started_at", F.current_timestamp()), root, "runs")
    assert registry.read(spark, root, "datasets").first()["row_count"] == 2
    every = registry.read_all(spark, root, "datasets")
    assert every.count() == 3
    assert registry.recent_runs(registry.read(spark, root, "runs"), every, registry.read(spark, root, "plans")).count() == 1
    plans = spark.createDataFrame([("p", "d", "{}")], "plan_id string, dataset_id string, plan_json string").withColumns(
        {"updated_at": F.lit(None).cast("timestamp"), "created_at": F.lit(None).cast("timestamp")})
    kept = registry.upsert_plans(plans.limit(0), plans, every)
    assert kept.first()["plan_json"] == "{}"


def test_curated_copy_and_train_test_tables(spark, tmp_path):
    from tablesmith.sources.artifacts import curate, write_train_test

    raw = spark.createDataFrame([(0, "name", "n"), (1, "a", "1"), (2, "b", "2")], "p long, _c0 string, _c1 string")
    log = curate(raw.select("p", "_c0", "_c1"), "movies", str(tmp_path), position=F.col("p")).first()
    assert log["status"] == "success" and log["original_shape"][0] == 3 and log["final_shape"][0] == 2
    assert spark.read.json(f"{tmp_path}/transform_log").count() == 1
    table = spark.createDataFrame([(1, 0, "train"), (2, 1, "train"), (3, 1, "test")], "x long, y long, split string")
    write_train_test(table, "y", f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f/X_train").columns == ["x"]
    assert rows(spark.read.parquet(f"{tmp_path}/f/y_test")) == [(1,)]


def test_landing_events_carry_durations(spark, tmp_path):
    from tablesmith.streaming.landing import ingest_paths

    good, bad = write(tmp_path / "a.csv", "x,y\n1,2\n"), str(tmp_path / "missing.csv")
    done = {r["file"]: r["status"] for r in ingest_paths(spark, [good, bad], f"{tmp_path}/w").collect()}
    assert done == {"a.csv": "completed", "missing.csv": "failed"}
    events = read_events(spark, f"{tmp_path}/w/events").collect()
    assert len(events) == 2 and all(e["duration_ms"] > 0 for e in events)


def test_documents_are_replaced_by_key(spark, tmp_path):
    from tablesmith.sources.artifacts import put_documents, read_documents

    path, schema = str(tmp_path / "docs"), "json string, dataset string, version string"
    assert read_documents(spark, path, schema).count() == 0
    for text, version in (("1", "007"), ("2", "8e1"), ("3", "007"), ("3", "007"), ("4", None)):
        put_documents(spark.createDataFrame([(text, "a b/c", version)], schema), path)
    assert sorted(map(str, rows(read_documents(spark, path, schema)))) == sorted(map(str, [("2", "a b/c", "8e1"), ("3", "a b/c", "007"), ("4", "a b/c", None)]))
    broken = spark.createDataFrame([("x", "a b/c", "007")], schema).withColumn("json", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        put_documents(broken, path)
    assert read_documents(spark, path, schema).where("json = '3'").count() == 1


def test_prepare_leaves_one_copy_of_each_document(spark, tmp_path):
    from tablesmith.sources.artifacts import PROFILE_DOCUMENT, REPORT_DOCUMENT, read_documents

    f = write(tmp_path / "people.csv", "PassengerId,Age,Survived\n" + "".join(f"{i},{i % 7},{i % 2}\n" for i in range(40)))
    root = str(tmp_path / "out")
    for _ in range(2):
        prepare(spark, f, root)
    docs = read_documents(spark, f"{root}/profiles", PROFILE_DOCUMENT)
    cols, meta = profiles_from_documents(docs)
    assert docs.count() == 1 and meta.first()["target_column"] == "Survived" and cols.count() == 3
    assert [r["validation_status"] for r in read_documents(spark, f"{root}/reports", REPORT_DOCUMENT).collect()] == ["valid"]
    states = stage_states(read_events(spark, f"{root}/events"))
    assert {r["step"] for r in states.where("status = 'completed' AND duration_ms > 0").collect()} == {"ingestion", "profile", "validation", "plan"}
    assert read_events(spark, f"{root}/events").where("status = 'started'").count() == 8


def test_failing_stages_leave_their_events(spark, tmp_path):
    root = str(tmp_path)
    log = RunLog(spark, f"{root}/events")
    with pytest.raises(ValueError, match="halfway"), log.stage("validation", "d", "v") as found:
        found["rows"] = 5
        time.sleep(0.05)
        raise ValueError("halfway")
    got = read_events(spark, f"{root}/events").orderBy("timestamp").collect()
    assert [r["status"] for r in got] == ["started", "failed"] and got[1]["duration_ms"] >= 50
    assert (got[1]["error_detail"], got[1]["details"]) == ("halfway", {"rows": "5"})
    df = spark.range(60).select("id", (F.col("id") % 2).alias("label"), F.when(F.col("id") == 59, F.raise_error(F.lit("late"))).otherwise(1.5).cast("double").alias("x"))
    with pytest.raises(Exception, match="late"):
        run_features(spark, df, root, "bad")
    good = run_features(spark, df.where("id < 50"), root, "good", keys=["id"], sample_rows=5)
    assert good.target == "label" and spark.read.parquet(f"{root}/samples/good").count() == 5
    assert spark.read.parquet(f"{root}/splits/good/X_test").count() == 10
    runs = {r["status"]: r for r in registry.read(spark, f"{root}/registry", "runs").collect()}
    assert set(runs) == {"failed", "completed"} and "late" in runs["failed"]["error_message"]
    assert runs["completed"]["rows_processed"] == 50 and runs["completed"]["execution_time_seconds"] > 0
    states = {r["dataset_name"]: r["status"] for r in stage_states(read_events(spark, f"{root}/events")).where("step = 'features'").collect()}
    assert states == {"bad": "failed", "good": "completed"}
    assert step_durations(read_events(spark, f"{root}/events")).where("step = 'features'").count() == 2


def test_many_files_are_validated_in_few_jobs(spark, tmp_path):
    from tablesmith.sources.grouped import group_cells, group_columns, layouts

    bodies = {
        "a": "id,name,x\n1,ann,0.5\n2,,1\n3,bob\n4,c,d,e\n", "b": "id;flag\n1;true\n2;False\n", "c": 'k\tt\n1\t"two\nlines"\n2\tNA\n',
        "d": "only,head\n", "e": "", "f": "n\u00e9e|z\n1|2\n"}
    paths = {}
    for i in range(60):
        name = "abcdef"[i % 6]
        paths[f"2024010{i % 9}_000000_{i:08x}_{name} {i}.csv"] = bodies[name]
    files = []
    for name, body in paths.items():
        (tmp_path / name).write_bytes(body.encode("latin-1" if "\u00e9" in body else "utf-8"))
        files.append(str(tmp_path / name))
    profiles = []
    for f in files:
        body, base = paths[f.rsplit("/", 1)[-1]], f.rsplit("/", 1)[-1].removesuffix(".csv")
        if body.startswith("id,"):
            profiles += [(base, 0, "id", "bigint", 0), (base, 1, "name", "string", 1), (base, 2, "x", "double", 1)]
        elif body.startswith("id;"):
            profiles += [(base, 0, "id", "bigint", 0), (base, 1, "flag", "string", 0), (base, 2, "gone", "string", 0)]
        elif body.startswith("k") or not body:
            profiles += [(base, 0, "k", "bigint", 0), (base, 1, "t", "string", 1)]
        elif body.startswith("n"):
            profiles += [(base, 0, "n\u00e9e", "bigint", 0), (base, 1, "z", "bigint", 0)]
    profiles = spark.createDataFrame(profiles, "dataset string, ordinal int, name string, spark_type string, missing_count long")
    files += [str(tmp_path / "odd.csv"), str(tmp_path / "20240101_000000_00ffffff_gone.csv")]
    profiles = profiles.unionByName(spark.createDataFrame([("20240101_000000_00ffffff_gone", 0, "k", "bigint", 0)], profiles.schema))

    def run(some, root):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(root, root)
        reports, results = run_validation(spark, some, profiles, str(tmp_path / root))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return reports, results, len(tracker.getJobIdsForGroup(root))

    reports, results, jobs = run(files, "w")
    by = {r["dataset_name"]: r for r in results.collect()}
    assert by["a 0"]["status"] == "valid" and by["c 2"]["status"] == "valid" and by["f 5"]["status"] == "valid"
    assert by["b 1"]["status"] == "invalid" and by["b 1"]["first_error"] == "Missing columns: gone" and by["b 1"]["errors_count"] == 2
    assert by["d 3"]["first_error"] == "Schema file not found" and by["d 3"]["status"] == "invalid"
    assert by["e 4"]["status"] == "failed" and "No columns" in by["e 4"]["first_error"]
    assert by["gone"]["status"] == "failed" and by["odd"]["status"] == "skipped"
    assert results.count() == 62 and reports.count() == 61
    events = read_events(spark, str(tmp_path / "w/events")).where("step = 'validation'")
    assert events.count() == 61 and events.where("status = 'failed'").count() == 21
    _, _, few = run(files[:6], "few")
    assert jobs <= few + 4
    again, _, _ = run(files, "w")
    assert again.count() == 61
    one = [f for f in files if "_a " in f][:1]
    cells = group_columns(group_cells(spark, layouts(spark, one))).collect()
    assert sorted((r["name"], r["spark_type"], r["row_count"], r["missing_count"]) for r in cells) == [
        ("id", "bigint", 3, 0), ("name", "string", 3, 1), ("x", "double", 3, 1)]
