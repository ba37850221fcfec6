"""Filter semantics against a plain Python evaluation, and what reaches the scan."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from facetframe.errors import ValidationError
from facetframe.filters import filter_table, predicate, to_column
from facetframe.schema import Column, TableSchema

ORDER = ("low", "mid", "high")
SCHEMA = TableSchema.of(
    Column("n", "continuous"), Column("c", "ordered-categorical", category_order=ORDER, categories=ORDER),
    Column("b", "boolean"), Column("s", "textual"),
)
ROWS = [
    (i, n, c, b, s)
    for i, (n, c, b, s) in enumerate(
        (n, c, b, s) for n in (None, 1.0, 2.0) for c in (None, "low", "mid", "high") for b in (None, True, False)
        for s in (None, "ab", "b.c")
    )
]

leaves = st.one_of(
    st.builds(lambda t, k: {"type": k, "target": t}, st.sampled_from("ncbs"), st.sampled_from(["empty", "not_empty"])),
    st.builds(lambda v, k: {"type": k, "target": "n", "value": v}, st.sampled_from([1, 2, 1.5]), st.sampled_from(
        ["equal_to", "greater_than", "less_than", "greater_than_or_equal_to", "less_than_or_equal_to"])),
    st.builds(lambda v, k: {"type": k, "target": "c", "value": v}, st.sampled_from(ORDER), st.sampled_from(
        ["equal_to", "greater_than", "less_than", "greater_than_or_equal_to", "less_than_or_equal_to"])),
    st.builds(lambda v: {"type": "is_one_of", "target": "c", "values": v}, st.lists(st.sampled_from(ORDER), max_size=2)),
    st.builds(lambda k: {"type": k, "target": "b"}, st.sampled_from(["is_true", "is_false"])),
    st.builds(lambda v: {"type": "has_text", "target": "s", "value": v}, st.sampled_from(["^b", "b", "b.c", "x"])),
)
filters = st.recursive(leaves, lambda inner: st.one_of(
    st.builds(lambda k, o: {"type": k, "operands": o}, st.sampled_from(["and", "or"]), st.lists(inner, max_size=3)),
    st.builds(lambda o: {"type": "not", "operand": o}, inner),
), max_leaves=6)


def holds(flt, row):
    import re

    kind = flt["type"]
    if kind == "not":
        return not holds(flt["operand"], row)
    if kind in ("and", "or"):
        results = [holds(f, row) for f in flt["operands"]]
        return True if not results else (all(results) if kind == "and" else any(results))
    value = dict(zip("incbs", row))[flt["target"]]
    if kind == "empty":
        return value is None
    if value is None:
        return False
    if kind == "not_empty":
        return True
    if kind in ("is_true", "is_false"):
        return value is (kind == "is_true")
    if kind == "has_text":
        return re.search(flt["value"], value) is not None
    if kind == "is_one_of":
        return value in flt["values"]
    other = flt["value"]
    if flt["target"] == "c":
        value, other = ORDER.index(value), ORDER.index(other)
    return {"equal_to": value == other, "greater_than": value > other, "less_than": value < other,
            "greater_than_or_equal_to": value >= other, "less_than_or_equal_to": value <= other}[kind]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "i int, n double, c string, b boolean, s string").coalesce(1).cache()


@given(st.lists(filters, min_size=25, max_size=25))
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
def test_masks_match_plain_python(rows, batch):
    out = rows.select("i", *[to_column(f, SCHEMA).alias(f"f{k}") for k, f in enumerate(batch)]).collect()
    for row in out:
        for k, f in enumerate(batch):
            assert row[f"f{k}"] == holds(f, ROWS[row["i"]]), f


@given(filters)
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_where_keeps_the_same_rows_as_the_mask(rows, flt):
    kept = {r["i"] for r in filter_table(rows, SCHEMA, flt).collect()}
    assert kept == {r[0] for r in ROWS if holds(flt, r)}
    dropped = {r["i"] for r in rows.filter(predicate(flt, SCHEMA, negate=True)).collect()}
    assert kept | dropped == {r[0] for r in ROWS} and not kept & dropped


@pytest.mark.parametrize("flt", [
    {"type": "greater_than", "target": "s", "value": "a"}, {"type": "is_true", "target": "n"},
    {"type": "has_text", "target": "n", "value": "1"}, {"type": "equal_to", "target": "c", "value": "none such"},
    {"type": "equal_to", "target": "n", "value": "abc"}, {"type": "equal_to", "target": "zz", "value": 1}, {"type": "xor"},
])
def test_bad_requests_are_refused_before_a_job(flt):
    with pytest.raises(ValidationError):
        to_column(flt, SCHEMA)


def test_negated_filters_reach_the_parquet_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    schema = TableSchema.of(Column("o_totalprice", "continuous"), Column("o_orderstatus", "categorical"))
    flt = {"type": "and", "operands": [
        {"type": "not", "operand": {"type": "greater_than", "target": "o_totalprice", "value": 1000}},
        {"type": "not", "operand": {"type": "equal_to", "target": "o_orderstatus", "value": "F"}},
    ]}
    plan = filter_table(df, schema, flt).select("o_orderkey")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "LessThanOrEqual(o_totalprice" in pushed and "EqualNullSafe(o_orderstatus" in pushed
