from __future__ import annotations

import math

import pytest

from evenhand import AuditFrame
from evenhand.frame import split_by_type
from evenhand.operators import clean, features
from evenhand.operators.features import CategoricalBlock, Encoder, NumericFeature


@pytest.fixture()
def frame(spark):
    rows = [
        (0, 1.0, 5, "b", "x", 1), (1, None, 5, "a", "y", 0), (2, 4.0, 5, None, "x", 1), (3, 10.0, 5, "a", None, 0),
        (4, 2.0, 5, "b", "it's", 0),
    ]
    df = spark.createDataFrame(rows, "id int, n double, flat int, c string, s string, label int")
    return AuditFrame(df, "label", "s", ("n", "flat"), ("c", "s"), row_id="id")


def test_fit(frame):
    e = features.fit_encoder(frame)
    n, flat = e.numeric
    assert n.median == 3.0  # midpoint of 2 and 4
    filled = [1.0, 3.0, 4.0, 10.0, 2.0]
    assert n.mean == pytest.approx(sum(filled) / 5)
    assert n.scale == pytest.approx(math.sqrt(sum((x - n.mean) ** 2 for x in filled) / 5))
    assert flat.scale == 1.0  # zero deviation
    assert e.block("c").mode == "a"  # tie of a and b
    assert e.block("s").categories == ("it's", "x", "y") and e.block("s").mode == "x"
    assert e.names()[:2] == ["n", "flat"] and e.names()[2:4] == ["c=a", "c=b"]


def test_transform_decode_and_unseen(spark, frame):
    e = features.fit_encoder(frame)
    new = spark.createDataFrame([(9, 3.0, 5, "zzz", "it's", 1)], frame.df.schema)
    wide = e.transform(new, ["id"])
    row = wide.first()
    assert row["c=a"] == row["c=b"] == 0.0 and row["s=it's"] == 1.0 and row["flat"] == 0.0
    back = e.decode(wide, ["id"]).first()
    assert back["c"] is None and back["s"] == "it's" and back["n"] == pytest.approx(3.0)
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in e.bounds_table(frame.df).collect()}
    assert bounds["c=a"] == (0.0, 1.0) and bounds["flat"] == (0.0, 0.0)


def test_refusals(spark, frame):
    empty = frame.with_df(frame.df.selectExpr("id", "cast(null as double) as n", "flat", "c", "s", "label"))
    with pytest.raises(ValueError, match="no values"):
        features.fit_encoder(empty)
    with pytest.raises(ValueError, match="unknown feature"):
        Encoder((NumericFeature("n"),)).text("m")
    with pytest.raises(ValueError, match="not in the frame"):
        AuditFrame(frame.df, "nope", "s")


def test_condition_forms_agree(spark):
    """The category shortcut of a threshold test equals the test of the 0/1 column."""
    e = Encoder((), (CategoricalBlock("c", ("a", "b")),))
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    for op in ("<=", ">"):
        for t in (-0.5, 0.0, 0.5, 1.0):
            plain = f"({e.text('c=a')}) {op} {t}D"
            rows = df.selectExpr(f"{e.condition('c=a', op, t)} as x", f"{plain} as y").collect()
            assert all(r["x"] == r["y"] for r in rows), (op, t)


def test_modes_and_columns(frame):
    assert frame.features()[1] == ["c", "s"]
    assert frame.features(include_sensitive=False)[1] == ["c"]
    with_proxy = AuditFrame(frame.df, "label", "s", ("n",), ("c", "s"), proxies=("c",))
    assert with_proxy.features(False, drop_proxies=True)[1] == []
    assert with_proxy.features(False)[1] == ["c"]
    assert split_by_type(frame.df, ("label",)) == (["id", "n", "flat"], ["c", "s"])
    assert clean.add_if_absent(frame.df, "n", 0) is frame.df
    assert "k" in clean.add_if_absent(frame.df, "k", 0).columns
