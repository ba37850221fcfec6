"""Fitting, inference and files on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from facetframe.errors import ValidationError
from facetframe.operators.fit import fit, java_pattern, nearest_day, refit, resolve_category_order
from facetframe.operators.infer import infer_schema
from facetframe.schema import INDEX, Column, TableSchema
from facetframe.sources import prepare_source, read_csv, read_workspace, to_records, with_row_index, write_workspace


def test_day_rounding_is_half_even(spark):
    # Day 0 is 1970-01-01: noon goes to the even day number, also before the epoch.
    cases = {
        "1970-01-01 12:00:00": "1970-01-01", "1970-01-02 12:00:00": "1970-01-03", "1970-01-01 12:00:01": "1970-01-02",
        "1969-12-31 12:00:00": "1970-01-01", "1969-12-30 12:00:00": "1969-12-30", "1969-12-30 13:00:00": "1969-12-31",
        "2024-01-01 18:00:00": "2024-01-02",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", nearest_day(F.col("t").cast("timestamp")).alias("d"))
    assert {r["t"]: r["d"].strftime("%Y-%m-%d") for r in df.collect()} == cases


def test_fit_types_and_nulls(spark):
    raw = spark.createDataFrame(
        [("1.5", "", "95", "x", "true", "2024-02-03"), ("oops", "text", "-90", None, "false", "never"), ("NaN", None, "10", "y", None, None)],
        "n string, t string, lat string, c string, b string, d string",
    )
    df, schema = fit(raw, TableSchema.of(
        Column("n", "continuous"), Column("t", "textual"), Column("lat", "geospatial", role="latitude"), Column("c", "categorical"),
        Column("b", "boolean"), Column("d", "temporal", datetime_format="%Y-%m-%d", temporal_features=("year", "monthly")),
    ))
    assert df.columns == ["n", "t", "lat", "c", "b", "d", "d (Year)", "d (Monthly)"]
    rows = df.collect()
    assert [r["n"] for r in rows] == [1.5, None, None]
    assert [r["t"] for r in rows] == [None, "text", None]
    assert [r["lat"] for r in rows] == [None, -90.0, 10.0]
    assert [r["b"] for r in rows] == [True, False, None]
    assert [r["d (Monthly)"] for r in rows] == ["February", None, None]
    assert schema.get("d (Year)").source_name == "d"


def test_category_order_puts_undeclared_first(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",), (None,), ("m",)], "c string")
    assert resolve_category_order(df, "c", ("m", "gone", "b")) == ("a", "z", "m", "b")
    assert resolve_category_order(df, "c", None) == ("a", "b", "m", "z")


def test_missing_columns_and_duplicates_are_refused(spark):
    with pytest.raises(ValidationError):
        fit(spark.createDataFrame([(1,)], "a int"), TableSchema.of(Column("b", "continuous")))
    with pytest.raises(ValidationError):
        TableSchema.of(Column("a", "unique"), Column("a", "textual"))


def test_refit_touches_only_what_changed(spark):
    source = spark.createDataFrame([(0, "1", "2024-01-01"), (1, "2", "2025-01-01")], f"`{INDEX}` long, a string, d string")
    before = TableSchema.of(Column("a", "unique"), Column("d", "temporal", temporal_features=("year",)))
    workspace, fitted = fit(source, before)
    after = TableSchema.of(Column("a", "continuous"), Column("d", "temporal", temporal_features=("year",)))
    marked = workspace.withColumn("d", F.lit(dt.datetime(2000, 1, 1)))  # would be lost by a full refit
    df, schema = refit(fitted, after, marked, source)
    assert df.columns == [INDEX, "a", "d", "d (Year)"]
    assert sorted(r["a"] for r in df.collect()) == [1.0, 2.0]
    assert {r["d"].year for r in df.collect()} == {2000}


def test_inference(spark):
    rows = [(i, float(i), "k%d" % (i % 2), "a text that is long enough %d" % i, "u%d" % i, None, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, latitude double, kind string, body string, code string, nothing string, flag boolean")
    found = {r["name"]: (r["type"], r["count"]) for r in infer_schema(df).collect()}
    assert found == {
        "id": ("continuous", 40), "latitude": ("geospatial", 40), "kind": ("categorical", 40), "body": ("textual", 40),
        "code": ("unique", 40), "nothing": ("unique", 0), "flag": ("continuous", 40),
    }


def test_csv_skips_long_rows_and_pads_short_ones(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a;b;;flag\n1;"x;y";q;True\n2;y\n3;z;q;False;extra\n4;NA;q;True\n')
    df = prepare_source(read_csv(spark, str(path), delimiter=";"))
    assert [c for c in df.columns if c != INDEX] == ["a", "b", "flag"]
    assert df.count() == 3
    rows = sorted(df.collect(), key=lambda r: r["a"])
    assert [(r["a"], r["b"], r["flag"]) for r in rows] == [(1, "x;y", True), (2, "y", None), (4, None, True)]
    assert sorted(r[INDEX] for r in rows) == [0, 1, 2]


def test_row_index_without_a_key(spark):
    df = with_row_index(spark.range(0, 1000, 1, 7).toDF("v"))
    assert [r[INDEX] for r in df.orderBy("v").collect()] == list(range(1000))


def test_workspace_keeps_the_schema(spark, tmp_path):
    raw = spark.createDataFrame([("b", 1), ("a", 2)], "c string, t int")
    df, schema = fit(raw, TableSchema.of(Column("c", "ordered-categorical"), Column("t", "topic")))
    write_workspace(df, schema, str(tmp_path / "w"))
    back, restored = read_workspace(spark, str(tmp_path / "w"))
    assert restored == schema and back.count() == 2
    with pytest.raises(ValidationError):
        write_workspace(back, restored, str(tmp_path / "w"))


def test_records_have_null_for_nan(spark):
    df = spark.createDataFrame([(float("nan"), None)], "x double, y string")
    assert to_records(df).first()["record"] == '{"x":null,"y":null}'


def test_strptime_patterns():
    assert java_pattern("%d/%m/%Y %H:%M:%S") == "dd/MM/yyyy HH:mm:ss"
    assert java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValidationError):
        java_pattern("%Q")


def test_plain_categories_are_part_of_the_schema(spark):
    from facetframe.filters import filter_table
    from facetframe.operators import profile

    raw = spark.createDataFrame([(0, "x", 1.0, True), (1, "y", 2.0, False), (2, None, 4.0, None), (3, "x", 6.0, True)], "`__index` long, c string, v double, b boolean")
    df, schema = fit(raw, TableSchema.of(Column("c", "categorical"), Column("v", "continuous"), Column("b", "boolean")))
    assert schema.get("c").categories == ("x", "y")
    with pytest.raises(ValidationError):
        filter_table(df, schema, {"type": "equal_to", "target": "c", "value": "z"})
    means = profile.aggregate_values(df, schema, "v", "b", "mean").collect()
    assert [tuple(r) for r in means] == [("False", 2.0), ("True", 3.5)]


def test_pages_by_position(spark, monkeypatch):
    """Pages beyond the near rows are the slices of the sorted table, with ties, NULLs and both directions."""
    from facetframe.operators import table

    monkeypatch.setattr(table, "NEAR", 30)
    monkeypatch.setattr(table, "SAMPLE", 64)
    monkeypatch.setattr(table, "RANGES", 8)
    values = [None if i % 9 == 0 else 5.0 if i % 3 else float(i * 37 % 101) for i in range(700)]
    flags = [None if i % 5 == 0 else i % 2 == 0 for i in range(700)]
    rows = [(i, v, f) for i, (v, f) in enumerate(zip(values, flags))]
    df = spark.createDataFrame(rows, f"{INDEX} long, v double, f boolean").repartition(5)
    schema = TableSchema.of(Column("v", "continuous"), Column("f", "boolean"))
    for sort in (None, ("v", True), ("v", False), ("f", True)):
        whole = [r[INDEX] for r in table.paginate(df, schema, sort=sort, limit=None).collect()]
        assert len(whole) == 700
        for page, limit in ((6, 5), (3, 50), (13, 50), (139, 5), (14, 50), (500, 7)):
            got = [r[INDEX] for r in table.paginate(df, schema, sort=sort, page=page, limit=limit).collect()]
            assert got == whole[page * limit : (page + 1) * limit], (sort, page, limit)
