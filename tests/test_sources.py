from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException

from evenhand.sources import readers, writers


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_census_files(spark, tmp_path):
    line = "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, "
    train = _write(tmp_path / "train", line + "<=50K\n" + line.replace("State-gov", "?") + ">50K\n\n")
    test = _write(
        tmp_path / "test",
        "|1x3 Cross validator\n" + line + ">50K.\n" + line.replace("Bachelors", "Only-in-test") + "<=50K.\n" + line + "?\n",
    )
    df = readers.load_adult(spark, train, test)
    rows = df.select("split", "workclass", "education", "label", "age").collect()
    train_rows = [(r["workclass"], r["education"], r["label"], r["age"]) for r in rows if r["split"] == "train"]
    assert sorted(train_rows, key=str) == [("State-gov", "Bachelors", 0, 39), (None, "Bachelors", 1, 39)]
    test_rows = [r for r in rows if r["split"] == "test"]
    assert sorted(r["label"] for r in test_rows) == [0, 1]  # the row without a label is gone
    assert "Only-in-test" in {r["education"] for r in test_rows}


def test_credit_file(spark, tmp_path):
    line = "A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1"
    other = line.replace("A93", "A92")[:-1] + "2"
    odd = "  " + line.replace("A93", "A99").replace(" ", "   ")
    path = _write(tmp_path / "german", "\n".join([line, other, odd]) + "\n")
    rows = {r["sex"]: r for r in readers.load_german(spark, path).collect()}
    assert set(rows) == {"male", "female", "unknown"}
    assert (rows["male"]["label"], rows["female"]["label"]) == (1, 0)
    assert rows["male"]["credit_amount"] == 1169 and rows["male"]["personal_status_sex"] == "A93"


def test_scholarship_file(spark, tmp_path):
    path = _write(
        tmp_path / "s.csv",
        "IPK,Semester,Asal_Daerah,Jumlah_Beasiswa_Per_Semester,Status_Kelayakan\n3.5,4,3T,100,Layak\n2.5,2,Perkotaan,0,Tidak\n",
    )
    df = readers.load_scholarship(spark, path)
    assert df.columns == ["IPK", "Semester", "Asal_Daerah", "label"]
    assert [r["label"] for r in df.orderBy("IPK").collect()] == [0, 1]
    assert dict(df.dtypes)["IPK"] == "double"


def test_missing_inputs_are_errors(spark, tmp_path):
    gone = str(tmp_path / "gone")
    for read in (
        lambda: readers.read_csv(spark, gone, "a int"),
        lambda: readers.read_documents(spark, gone),
        lambda: readers.read_blank_separated(spark, gone, "a int"),
        lambda: readers.read_headerless_csv(spark, gone, "a int"),
    ):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read().collect()


def test_documents(spark, tmp_path):
    doc = {
        "dataset": "d", "model": "m", "sensitive_attribute": "s", "overall_status": "SAT",
        "pair_checks": [
            {"source_group": "a", "target_group": "b", "status": "sat", "score_x": "0", "score_y": "1/2", "prediction_x": 0,
             "prediction_y": 1, "example_x": {"n": 1.5, "s": "a"}, "example_y": {"n": 1.5, "s": "b"}},
            {"source_group": "b", "target_group": "a", "status": "sat"},
        ],
        "runtime_seconds": 0.5, "timeout": False, "ce_bound": 100, "ce_found": 2, "logreg_intercept": 1.0,
    }
    doc["first_counterexample"] = doc["pair_checks"][0]
    _write(tmp_path / "a.json", json.dumps(doc, indent=2))
    plain = {k: v for k, v in doc.items() if k not in ("first_counterexample", "runtime_seconds")}
    _write(tmp_path / "b.json", json.dumps({**plain, "model": "k", "overall_status": "UNSAT", "first_counterexample": None}, indent=2))
    df = readers.read_documents(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    rows = {r["model"]: r for r in df.collect()}
    assert rows["m"]["first_counterexample"]["prediction_y"] == "1"
    assert rows["m"]["first_counterexample"]["example_x"] == {"n": "1.5", "s": "a"}
    assert rows["k"]["first_counterexample"] is None
    assert readers.explode_pairs(df).count() == 4


def test_nan_text(spark):
    df = spark.createDataFrame([("NaN",), ("a -> b",), (None,)], "pair string")
    assert [r[0] for r in readers.nan_to_null(df, ["pair"]).collect()] == [None, "a -> b", None]


def test_tagged_files(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "model,n_samples\ntree,200\n")
    b = _write(tmp_path / "b.csv", "dataset,model,top_k\nadult,tree,500\n")
    df = readers.read_tagged(
        spark, {a: {"dataset": "scholarship", "baseline": "random"}, b: {"dataset": "ignored", "baseline": "boundary"}}
    )
    got = {r["baseline"]: (r["dataset"], r["n_samples"], r["top_k"]) for r in df.collect()}
    assert got == {"random": ("scholarship", 200, None), "boundary": ("adult", None, 500)}
    c = _write(tmp_path / "c.csv", "model,n\ntree,1\n")
    d = _write(tmp_path / "d.csv", "model,n\ntree,2\n")
    one = readers.read_tagged_folder(spark, [c, d], {"c.csv": {"part": "x"}, "d.csv": {"part": "y"}}, "model string, n int")
    assert {(r["part"], r["n"]) for r in one.collect()} == {("x", 1), ("y", 2)}
    with pytest.raises(PySparkException, match="0 tags for file"):
        readers.read_tagged_folder(spark, [c, d], {"c.csv": {"part": "x"}}, "model string, n int").collect()


def test_equal_file_names_have_their_own_tags(spark, tmp_path):
    paths = []
    for k, run in enumerate(("run1", "run2")):
        (tmp_path / run).mkdir()
        paths.append(_write(tmp_path / run / "summary.csv", f"model,n\ntree,{k}\n"))
    tags = {"run1/summary.csv": {"part": "x"}, "run2/summary.csv": {"part": "y"}}
    got = readers.read_tagged_folder(spark, paths, tags, "model string, n int").collect()
    assert {(r["part"], r["n"]) for r in got} == {("x", 0), ("y", 1)}
    with pytest.raises(PySparkException, match="2 tags for file"):
        readers.read_tagged_folder(spark, paths[:1], {"summary.csv": {"part": "x"}, **tags}, "model string, n int").collect()


def test_malformed_input_raises(spark, tmp_path):
    csv = _write(tmp_path / "bad.csv", "model,n\ntree,xx\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_csv(spark, csv, "model string, n int").collect()
    assert readers.read_csv(spark, csv, "model string, n int", mode="PERMISSIVE").first()["n"] is None
    blank = _write(tmp_path / "bad.txt", "a 1\nb x\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="cannot hold x"):
        readers.read_blank_separated(spark, blank, "k string, n int").collect()
    document = _write(tmp_path / "bad.json", '{"dataset": "d", "model": ')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_documents(spark, document).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5, {"a": 0.5}, None)], "model string, v double, rates map<string,double>, gap double")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["rates"] == '{"a":0.5}'
    writers.write_json(df, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part*.json"))
    assert '"gap":null' in text
    records = writers.run_record(df, "model", "2026-05-30 14:21:24")
    writers.append_run(records, str(tmp_path / "runs"))
    writers.append_run(records, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == 6 and {r["key"] for r in back.collect()} == {"v", "rates", "gap"}
    assert {str(r["run_date"]) for r in back.collect()} == {"2026-05-30"}
