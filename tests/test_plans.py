"""Plan rules, cascade, output repair, execution, validation and pairs."""

import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesmith.operators import validate as va
from tablesmith.operators.profile import profile
from tablesmith.plans import execute as ex
from tablesmith.plans import normalize as nz
from tablesmith.plans import pairs as pr
from tablesmith.plans.repair import balanced_block, parse_outputs, plan_fragment
from tablesmith.plans.rules import rule_plans


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"p{i}", "abc"[i % 3], None if i % 5 == 0 else i * 1.0, float(i * i), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "user_id long, name string, city string, age double, pay double, churn long")


@pytest.fixture(scope="module")
def people_profile(spark, people):
    return profile(people, "people").cache()


def test_rule_plan(people_profile):
    r = rule_plans(people_profile).first()
    assert (r["target_column"], r["task_type"], r["class_count"]) == ("churn", "classification", 2)
    assert r["drop_columns"] == ["user_id"] and r["impute_numeric"] == ["age"]
    assert r["one_hot_encode"] == ["city"] and r["label_encode"] == ["name"]
    assert r["smote"]["would_apply_if"] and not r["smote"]["enabled"]


def test_cascade_levels(spark, people_profile):
    def final(raw):
        outs = spark.createDataFrame([("people", raw)], "dataset string, raw_output string")
        return nz.dispatch(people_profile, outs).first()

    good = final(json.dumps({
        "target_column": "churn", "preprocessing": {
            "drop_columns": ["name", "nope", "churn"], "scaling": {"strategy": "odd", "columns": "not a list"},
            "imputation": {"categorical_strategy": "mode", "numeric_columns": []}, "encoding": {"one_hot_columns": ["city", "age"]}}}))
    assert good["final_decision"] == "accepted_transformer_plan"
    assert good["drop_columns"] == ["name"] and good["one_hot_columns"] == ["city"]
    assert good["scaling_strategy"] == "standard" and good["scaling_columns"] == ["age", "pay"]  # absent, so defaults
    assert good["numeric_columns"] == []  # given and empty, so empty
    assert good["categorical_strategy"] == "most_frequent"
    weak = final('{"target_column": "user_id"}')
    assert weak["final_decision"] == "used_plan_generator_fallback"
    assert "ID/date" in weak["fallback_reason"]
    assert final(None)["rejection_reasons"].endswith("fallback_no_model_output")
    lost = nz.dispatch(people_profile, rules=rule_plans(people_profile).limit(0)).first()
    assert lost["final_decision"] == "used_internal_safe_fallback" and lost["label_encoding_columns"] == ["name", "city"]
    for row in (good, weak, lost):
        lists = [row[c] for c in nz.PROTECTED]
        assert all(row["target_column"] not in names for names in lists)


def test_nested_plan_layout(spark, people_profile):
    raw = json.dumps({"preprocessing_plan": {"target_column": "city", "preprocessing": {"log_transform": ["pay"]},
                                             "split_strategy": {"test_size": 0.3}, "smote": {"enabled": True}}})
    outs = spark.createDataFrame([("people", raw)], "dataset string, raw_output string")
    got = nz.normalize(nz.model_proposals(nz.dataset_facts(people_profile), outs)).first()
    assert (got["target_column"], got["log_transform"], got["test_size"]) == ("city", ["pay"], 0.3)
    assert got["smote_enabled"] and got["random_state"] == 42
    assert nz.normalize(nz.model_proposals(nz.dataset_facts(people_profile), outs)).select(
        nz.plan_struct().alias("plan")).first()["plan"]["_debug"]["parse_status"] == "json_direct"


def test_output_repair_ladder(spark):
    cases = {
        '{"a":1}': "json_direct", "[1]": "json_direct", '{"a":[1,{"b":2}': "json_bracket_repair",
        'see {"a":"}"} end': "json_regex_block", '"preprocessing_plan": {"a":[1,2,': "json_preprocessing_plan_block",
        'x "target_column": "y"': "regex_critical_fields", "junk": "fallback_parse_failed", "": "fallback_no_model_output",
        '{"a":1}],[x': "json_regex_block", '{"a":1},"z":2': "json_regex_block",
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw_output string")
    got = {r["raw_output"]: r for r in parse_outputs(df).collect()}
    assert {c: got[c]["parse_status"] for c in cases} == cases
    assert json.loads(got["[1]"]["parsed"]) == {}
    assert json.loads(got['"preprocessing_plan": {"a":[1,2,']["parsed"]) == {"preprocessing_plan": {"a": [1, 2]}}


def test_repair_helpers():
    assert balanced_block('a {"x": "}{", "y": {"z": "\\""}} {') == '{"x": "}{", "y": {"z": "\\""}}'
    assert balanced_block("{ never") is None and balanced_block("none") is None
    assert plan_fragment('"preprocessing_plan": {"a": {"b": [1, "c"') == {"a": {"b": [1, "c"]}}
    assert plan_fragment('"preprocessing_plan": {"a": {"b": 1}} , "x": 2}') == {"a": {"b": 1}}
    assert plan_fragment("no plan") == {}


PIECES = ['{', '}', '[', ']', '"a"', '"b{"', '"]c"', ':', ',', ' ', '1', '-2.5e3', '1.', 'true', 'nul', 'NaN', '"\\\\u00e9"', '"\\\\x"', '"open', '\\n']


def closed(prefix):
    """A cut text with the signs that its plain counts lack, read as JSON; none if that fails."""
    kept = prefix.rstrip().rstrip(",")
    lacking = "".join(b * max(kept.count(a) - kept.count(b), 0) for a, b in ("[]", "{}"))
    try:
        return [json.loads(kept + lacking)]
    except ValueError:
        return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.booleans())
def test_fragment_is_the_longest_prefix_that_closes(parts, member):
    body = "{" + ('"k":' if member else "") + "".join(parts)
    readable = [value for k in range(1, len(body) + 1) if (value := closed(body[:k]))]
    assert repr(plan_fragment('"preprocessing_plan": ' + body)) == repr(readable[-1][0] if readable and isinstance(readable[-1][0], dict) else {})


def test_fragment_of_a_long_text_takes_linear_time():
    item = '{"name": "column \\\\" with ] and [", "values": [1, 2.5, null]}, '
    body = '{"columns": ' + '{"x": ' * 50 + '{"y": "' + "z" * 400_000 + '", "w": [' + "[1, 2], " * 80_000
    for text in (body, '{"a": [' + item * 12_000, '{"a": "' + "b" * 1_000_000, '{"a": ' + '"' + "\\\\" * 1_000_000):
        start = time.process_time()
        plan_fragment('"preprocessing_plan": ' + text)
        assert time.process_time() - start < 1


def test_apply_plan(people):
    plan = {
        "target_column": "churn", "task_type": "classification",
        "preprocessing": {
            "drop_columns": ["user_id", "churn"], "log_transform": ["pay"],
            "imputation": {"numeric_strategy": "median", "numeric_columns": ["age"], "categorical_strategy": "most_frequent",
                           "categorical_columns": ["city"], "constant_value": "Unknown"},
            "encoding": {"one_hot_columns": ["city"], "label_encoding_columns": ["name"]},
            "scaling": {"strategy": "standard", "columns": ["age", "name"]}},
        "split_strategy": {"test_size": 0.25, "random_state": 1, "stratify": True},
    }
    done = ex.apply_plan(people.unionByName(people.limit(4)), plan, dedup=True, cap=["pay"])
    out = done.frame.toPandas()
    assert done.duplicates_removed == 4 and len(out) == 40
    assert list(out.columns) == ["name", "city_a", "city_b", "city_c", "age", "pay", "churn", "split"]
    assert out.groupby(["churn", "split"]).size().to_dict() == {(0, "test"): 5, (0, "train"): 15, (1, "test"): 5, (1, "train"): 15}
    assert out.age.mean() == pytest.approx(0, abs=1e-9) and (out[["city_a", "city_b", "city_c"]].sum(axis=1) == 1).all()
    assert done.steps == ["dedup", "drop", "impute_numeric", "impute_categorical", "cap_outliers", "log_transform",
                          "label_encode", "one_hot", "scale", "split"]


def test_modes_and_bounds(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", None), (None, 100.0)], "s string, x double")
    assert ex.column_modes(df, ["s"]) == {"s": "a"}  # smallest of the most frequent
    capped = [r["x"] for r in ex.cap_outliers(df, ["x"]).collect()]
    assert capped[3] is None and max(v for v in capped if v is not None) < 100
    wide = spark.range(51).select(F.when(F.col("id") < 50, F.col("id").cast("string")).alias("s"), F.lit(1).alias("s_index_"))
    sparse = ex.one_hot(wide, ["s"], form="index")
    dense = ex.one_hot(wide, ["s"])
    assert sparse.columns == ["s_index", "s_size", "s_index_"] and sparse.where("s_size = 50").count() == 51
    order = [c.removeprefix("s_") for c in dense.columns[:-1]]
    assert sorted(r[0] for r in sparse.select("s_index").collect() if r[0] is not None) == list(range(50))
    assert order == sorted(order) and sparse.where("s_index IS NULL").count() == 1


def test_one_hot_keeps_its_form_at_any_width(spark):
    wide = spark.range(1500).select(F.col("id").cast("string").alias("s"))
    assert len(ex.one_hot(wide, ["s"]).columns) == 1500
    assert ex.one_hot(wide.limit(2), ["s"], form="index").columns == ["s_index", "s_size"]


def test_modes_of_many_columns_in_two_jobs(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hot"), F.col("id").alias("unique"),
        (F.col("id") % 9 / 2).alias("real"), F.date_add(F.lit("2024-01-31").cast("date"), (F.col("id") % 40).cast("int")).alias("day"),
        (F.col("id") % 4 == 0).alias("flag"), F.lit(None).cast("string").alias("none"),
        (F.col("id") % 5).cast("decimal(20,3)").alias("dec"), F.when(F.col("id") % 2 == 0, float("nan")).alias("nan"))
    pdf = df.toPandas()
    want = {c: (m[0] if len(m := pdf[c].dropna().mode()) else None) for c in pdf.columns}
    for cells, counted in ((1024, 64), (8, 1), (3, 3)):
        got = ex.column_modes(df, df.columns, cells, counted)
        assert got == want, (cells, got, want)
    assert ex.column_modes(df.limit(0), ["hot", "none"]) == {"hot": None, "none": None}


def test_split_without_keys_and_with_copies(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("v"), F.lit("y").alias("_row"))
    plan = {"target_column": "v", "preprocessing": {
        "drop_columns": [], "log_transform": [], "imputation": {"numeric_columns": [], "categorical_columns": []},
        "encoding": {"one_hot_columns": [], "label_encoding_columns": []}, "scaling": {"strategy": "none", "columns": []}}}
    done = ex.apply_plan(df, plan)
    assert done.frame.columns == ["v", "_row", "split"] and done.frame.where("split = 'test'").count() == 200


def test_dispatched_plan_is_applied(spark, people, people_profile):
    row = nz.dispatch(people_profile).first()
    done = ex.apply_plan(people, row)
    assert done.frame.count() == people.count() and done.steps[-1] == "split"
    nested = nz.dispatch(people_profile).select(nz.plan_struct().alias("p")).first()["p"]
    flat = ex.contract_plan(row)
    assert {k: v for k, v in nested.asDict(recursive=True).items() if k != "_debug"} == flat


def test_validation_run(spark, people, people_profile):
    base = "20240101_010101_0a1b2c3d_people"
    expected = people_profile.withColumn("dataset", F.lit(base))
    tables = {f"{base}.csv": (people, None), "oddname.csv": (people, None),
              "20240101_010101_11111111_gone.csv": (people, None),
              "20240101_010101_0a1b2c3d_people.xls": (None, "cannot read")}
    reports, results = va.validate_many(spark, tables, expected)
    by = sorted((r["dataset_name"], r["status"], r["first_error"] or "") for r in results.collect())
    assert by == [("gone", "invalid", "Schema file not found"), ("oddname", "skipped", "Unexpected filename format"),
                  ("people", "failed", "Failed to read or validate dataset: cannot read"), ("people", "valid", "")]
    tally = {r["validation_status"]: r["datasets"] for r in va.validation_summary(reports).collect()}
    assert tally == {"valid": 1, "invalid": 2}
    worse = va.validate(people.drop("city").withColumn("extra", F.lit(1)), people_profile, "people").first()
    assert worse["errors"] == ["Missing columns: city", "Extra columns: extra"] and not worse["is_valid"]


def test_parse_scores(spark):
    df = spark.createDataFrame([(["id", "age"],), (["id;age"],), ([],), (["id", "zz"],)], "f array<string>")
    want = F.array(F.lit("id"), F.lit("age"))
    got = [r[0] for r in df.select(va.parse_score(F.col("f"), want)).collect()]
    assert got == [20, -107, -9999, 6]


def test_list_text_is_python_text(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "line\nbreak", "back\\slash"]
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(pr.list_text(F.col("v"), 6)).first()[0] == str(values)
    assert df.select(pr.list_text(F.col("v"), 2)).first()[0] == str(values[:2])


def test_pairs_take_the_plan_when_there_is_one(spark, people_profile):
    meta = spark.createDataFrame(
        [("people", "people.csv", "s", "p", "0a1b2c3d", "t", ".csv", 40, 6, ["user_id"])],
        "dataset string, original_filename string, stored_filename string, stored_path string, version_id string, "
        "timestamp string, file_type string, rows long, columns_count int, columns array<string>")
    from tablesmith.facade import dataset_meta

    facts = dataset_meta(people_profile)
    plan = spark.createDataFrame([("0a1b2c3d", '{"task_type":"regression","preprocessing":{"drop_columns":["x"]}}')],
                                 "version_id string, json string")
    out = json.loads(pr.comprehensive_plans(meta, people_profile, facts, plans=plan).first()["output"])
    assert out["preprocessing_plan"]["preprocessing"] == {"drop_columns": ["x"]}
    assert out["schema"]["task_type"] == "regression" and out["validation"]["validation_status"] == "unknown"
    assert out["preprocessing_plan"]["split_strategy"]["stratify"] is False
    bare = json.loads(pr.comprehensive_plans(meta, people_profile, facts).first()["output"])
    assert bare["preprocessing_plan"]["preprocessing"]["encoding"] == {
        "one_hot_columns": ["city"], "label_encoding_columns": ["name"]}
    assert bare["preprocessing_plan"]["split_strategy"] == {}
    prompts = pr.pair_prompts(meta, people_profile, facts)
    pairs = pr.build_pairs(prompts, pr.comprehensive_plans(meta, people_profile, facts))
    assert {r["id"] for r in pairs.collect()} == {f"0a1b2c3d_{v}" for v in pr.LABELS}


def test_artifact_match_with_a_common_name(spark):
    from tablesmith.plans.pairs import match_artifacts

    versions = spark.createDataFrame([(f"v{i}", "data") for i in range(40)], "version_id string, dataset string")
    files = spark.createDataFrame([("validation_summary.json", "{}"), *[(f"data_{i:02d}.json", str(i)) for i in range(40)], ("x_v7.json", "v")],
                                  "file_name string, json string")
    got = {r["version_id"]: (r["file_name"], r["json"]) for r in match_artifacts(versions, files).collect()}
    assert len(got) == 40 and got["v7"] == ("x_v7.json", "v") and got["v1"] == ("data_00.json", "0")


def test_artifact_match_deals_substrings_to_tasks(spark, monkeypatch):
    """However few parts the files have, and with the results of a plain search."""
    kept, plans = getattr(pr, "stored", None), []
    monkeypatch.setattr(pr, "PIECES", 500, raising=False)
    monkeypatch.setattr(pr, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df), raising=False)
    files = [(["ds_{0:03d}_SET.json", "x_v{0:03d}a_y.json", "other_{0}.json"][i % 3].format(i), str(i) if i % 4 else None) for i in range(150)]
    files += files[:9] + [(None, "{}"), ("", "{}")]
    versions = [(f"v{i:03d}a", f"Ds-{i:03d} set") for i in range(150)] + [(None, "Ds-003 set"), ("v001a", None), ("", "")]
    rows = spark.createDataFrame(files, "file_name string, json string").coalesce(1)
    hits = pr.match_artifacts(spark.createDataFrame(versions, "version_id string, dataset string"), rows, fold=True)
    names = sorted({f for f, _ in files if f})
    fold = lambda t: t.lower().replace(" ", "").replace("_", "").replace("-", "")
    want = set()
    for v, d in versions:
        by_version = [f for f in names if v and v in f]
        by_name = [f for f in names if d and fold(d) in fold(f.rsplit(".", 1)[0])]
        if by_version or by_name:
            want.add((v, (by_version or by_name)[0]))
    assert {(r["version_id"], r["file_name"]) for r in hits.collect()} == want and len(want) > 100
    tasks = [int(n) for p in plans for n in re.findall(r"hashpartitioning\(piece#\d+, (\d+)\)", p)]
    assert len(plans) == 2 and min(tasks) >= 3
