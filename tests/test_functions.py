"""Edge cases of parsing, labels and verdicts."""

import json
import hashlib

import pytest
from pyspark.sql import functions as F

from curafold.functions import measurement as fm
from curafold.functions import sets as fs
from curafold.functions import target as ft

CASES = [
    ("10-20", -5.0, False, "ok"),
    ("10 - 20", 15.0, False, "ok"),
    ("1,000", 0.5, False, "ok"),
    ("5e3", 5000.0, False, "ok"),
    (">100", 100.0, True, "ok"),
    ("&gt; 50", 50.0, True, "ok"),
    ("12.5 mg", 12.5, False, "ok"),
    ("1.", 1.0, False, "ok"),
    ("-.5", -0.5, False, "ok"),
    ("abc", None, False, "no_numeric"),
    ("not less than 5", 5.0, True, "ok"),
    ("Greater Than nothing", None, True, "no_numeric"),
    ("≥ 3", 3.0, True, "ok"),
    ("", None, False, "no_numeric"),
    (None, None, False, "missing"),
]


def test_parse_measurement(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    rows = df.select("i", fm.parse_measurement(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [(r.p.value, r.p.is_limit, r.p.note) for r in rows] == [c[1:] for c in CASES]


def test_parse_numeric_input(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "raw double")
    rows = df.select(fm.parse_measurement(F.col("raw")).alias("p")).collect()
    assert [(r.p.value, r.p.note) for r in rows] == [(1.5, "ok"), (None, "missing"), (None, "missing")]


def test_normalize_source(spark):
    raw = ["1", "1.0", " 2 ", "Registry-A v2", "x", None]
    df = spark.createDataFrame([(r,) for r in raw], "s string")
    label = fm.normalize_source(F.col("s"), {"1": "A", "1.0": "A", "2": "B"}, {"registry-a": "A"})
    assert [r[0] for r in df.select(label).collect()] == ["A", "A", "B", "A", "Unknown", "Unknown"]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Raw Value (x)` int, `Other_Name` int, `value` int")
    assert fm.resolve_column(df, ["VALUE"]) == "value"
    assert fm.resolve_column(df, ["rawvalue"]) == "Raw Value (x)"
    assert fm.resolve_column(df, ["nothing like it"]) is None
    with pytest.raises(ValueError, match="no column found"):
        fm.require_columns(df, {"a": ["zzz"]})


def test_strict_double(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("Infinity",)], "s string")
    rows = df.select(fm.strict_double(F.col("s")).alias("p")).collect()
    assert [r.p.problem for r in rows] == [None, "not_numeric", "missing", "not_finite"]


def test_target_round_trip(spark):
    df = spark.createDataFrame([(120.0, 40.0), (0.0, 40.0), (1.0, 0.0)], "v double, w double")
    y = ft.to_log_target(F.col("v"), F.col("w"))
    rows = df.select(y.alias("y"), ft.from_log_target(y, F.col("w")).alias("back")).collect()
    assert rows[0].back == pytest.approx(120.0)
    assert rows[1].y is None and rows[2].y is None


def test_stable_id_equals_json_hash(spark):
    value = {"a": 'q"\\ é', "b": 3}
    df = spark.createDataFrame([(value["a"], value["b"])], "a string, b int")
    canonical = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    expected = hashlib.sha256(canonical.encode()).hexdigest()[:20]
    assert df.select(ft.stable_id("a", "b")).first()[0] == expected


def test_labels(spark):
    df = spark.createDataFrame([(1.0,), (0.7,), (0.69,), (None,)], "s double")
    assert [r[0] for r in df.select(ft.similarity_band(F.col("s"))).collect()] == ["identical", "near", "out", "out"]
    rho = spark.createDataFrame([(0.2,), (-0.2,), (0.0,), (None,), (float("nan"),)], "r double")
    labels = [r[0].split()[0] for r in rho.select(ft.direction_label(F.col("r"))).collect()]
    assert labels == ["increases", "decreases", "no", "no", "no"]
    assert ft.arm_label(None) == "no_filter" and ft.arm_label(20.0) == "filter_20fold"
    arms = spark.createDataFrame([("no_filter",), ("filter_2.5fold",)], "arm string")
    assert [r[0] for r in arms.select(ft.arm_threshold(F.col("arm"))).collect()] == [None, 2.5]


def test_entity_validity_order(spark):
    rows = [
        (None, True, ["aaa"], ["C"], 9, "missing"),
        ("  ", True, ["aaa"], ["C"], 9, "empty"),
        ("x", False, ["aaa"], ["C"], 9, "unparsable"),
        ("x", True, ["aaaa", "bb"], ["C"], 9, "several_comparable_parts"),
        ("x", True, ["aaaaa", "bb"], ["N"], 9, "required_member_absent"),
        ("x", True, ["aaaa"], ["C", "Zn", "Fe"], 1, "disallowed_members:Fe,Zn"),
        ("x", True, ["aaaa"], ["C"], 3, "too_small"),
        ("x", True, ["aaaa"], ["C"], 4, "ok"),
    ]
    df = spark.createDataFrame(rows, "raw string, p boolean, parts array<string>, m array<string>, n int, want string")
    verdict = fs.entity_validity(F.col("raw"), F.col("p"), F.col("parts"), F.col("m"), F.col("n"), "C", ["C", "N"], 4)
    assert all(r.got == r.want for r in df.select("want", verdict.alias("got")).collect())
