"""Cleaning rules that follow the data they see."""

import datetime

import pytest

from panelcast.operators import cleaning, reshape


def test_sex_rule_follows_type_and_values(spark):
    def coded(values, kind):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
        return [r.out for r in cleaning.encode_sex(df, "s", "out").orderBy("i").collect()]

    assert coded([" m", "Female", "1", "2", "x", None], "string") == [1, 0, 1, 0, None, None]
    assert coded([0, 1, None], "int") == [0, 1, None]
    assert coded([1.0, 2.0, None], "double") == [1, 0, None]
    assert coded([1, 2, 3], "int") == [1, 2, 3]
    assert coded([1, 1], "int") == [1, 1]
    assert coded([None], "int") == [None]


def test_status_takes_what_is_there(spark):
    df = spark.createDataFrame(
        [(1, " parkinson's", "61,5", "2", "x", "BL"), (2, "Healthy", "<40", "?", "x", "BL"), (3, None, None, None, "x", "BL")],
        "PATNO int, DEF string, AGE string, COHORT string, ENROLL_STATUS string, EVENT_ID string",
    )
    out = cleaning.encode_status(df, "DEF", "AGE").orderBy("PATNO")
    assert out.columns == ["PATNO", "AGE", "COHORT", "IS_PD"]
    assert [tuple(r) for r in out.collect()] == [(1, 61.5, 2, 1), (2, 40, None, 0), (3, None, None, None)]
    bare = cleaning.encode_status(df.select("PATNO"), "DEF", "AGE")
    assert bare.columns == ["PATNO", "IS_PD"] and bare.where("IS_PD is not null").count() == 0


def test_code_filter_long_wide_and_neither(spark):
    long = spark.createDataFrame([(1, "AL-B"), (2, "alb "), (3, "HGB"), (4, None)], "i int, code string")
    assert sorted(r.i for r in cleaning.keep_codes(long, ["i"], ["Alb"], "code").collect()) == [1, 2]
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "i int, `Al b` double, HGB double")
    assert cleaning.keep_codes(wide, ["i"], ["ALB"], "code").columns == ["i", "Al b"]
    assert cleaning.keep_codes(wide, ["i"], ["XYZ"], "code").columns == wide.columns


def test_mixed_columns_choose_median_or_first(spark):
    d = datetime.date
    rows = [
        (1, "a", 5, "3 mg", None, 1.0, "late", d(2001, 1, 1)), (1, "a", 4, "x", "first", 2e8, None, d(2004, 1, 1)), (1, "a", 6, "<5", "second", 4e8, "x", None),
        (None, "a", 1, None, "lone", None, None, None), (None, "a", 2, "7", None, 9.0, None, None), (2, None, 3, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, e string, ord int, dose string, note string, num double, remark string, day date").repartition(3)
    out = reshape.mixed_dedup(df, ["k", "e"], "ord")
    assert out.columns == ["k", "e", "dose", "note", "num", "remark", "day"]
    got = {(r.k, r.e): tuple(r)[2:] for r in out.collect()}
    assert got == {
        (1, "a"): (4, "first", 2e8, "late", 2002.5), (None, "a"): (7, "lone", 9, None, None), (2, None): (None,) * 5,
    }
    assert reshape.mixed_dedup(df.limit(0), ["k", "e"], "ord").count() == 0
    assert reshape.mixed_dedup(df.select("k", "ord"), ["k"], "ord").count() == 3


def test_names_to_columns_come_from_the_data(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "new code", 3.0), (2, "a", None), (2, None, 1.0)], "k int, f string, value double")
    names = reshape.observed_names(df, "f")
    assert names == ["a", "b", "new code"]
    wide = {r.k: tuple(r)[1:] for r in reshape.pivot_values(df, ["k"], "f", names).collect()}
    assert wide == {1: (None, 2, 3), 2: (None, None, None)}
    with pytest.raises(ValueError, match="more than 2"):
        reshape.observed_names(df, "f", most=2)
