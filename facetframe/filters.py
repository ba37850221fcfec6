"""Filter trees (plain dictionaries) turned into Catalyst predicates.

The filter language is two-valued: a comparison with NULL is simply false, also
underneath ``not``. Every tree is rewritten so that negation sits on the leaves,
where it is spelled with null-safe comparisons. What is left is a monotone
AND/OR formula, in which SQL's "unknown" can only mean "false". So

* a WHERE clause may use the formula as it is, and its conjuncts reach the
  Parquet scan, negated ones included;
* a mask column needs one ``coalesce(..., false)`` around the whole formula.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .errors import ValidationError
from .schema import INDEX, Column, TableSchema, quoted

Filter = dict

_ANY = {"empty", "not_empty", "equal_to", "is_one_of"}
_RANGE = {"greater_than", "less_than", "greater_than_or_equal_to", "less_than_or_equal_to"}
_TEXT = {"has_text"}
_FLAG = {"is_true", "is_false"}

ALLOWED = {
    S.CATEGORICAL: _ANY | _TEXT,
    S.ORDERED: _ANY | _TEXT | _RANGE,
    S.TEXTUAL: _ANY | _TEXT,
    S.UNIQUE: _ANY | _TEXT,
    S.CONTINUOUS: _ANY | _RANGE,
    S.GEOSPATIAL: _ANY | _RANGE,
    S.TEMPORAL: _ANY | _RANGE,
    S.BOOLEAN: _ANY | _FLAG,
    S.TOPIC: _ANY | _RANGE,
}

_OPPOSITE = {
    "greater_than": "less_than_or_equal_to",
    "less_than": "greater_than_or_equal_to",
    "greater_than_or_equal_to": "less_than",
    "less_than_or_equal_to": "greater_than",
}
_COMPARE = {
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "greater_than_or_equal_to": lambda a, b: a >= b,
    "less_than_or_equal_to": lambda a, b: a <= b,
}


def parse_operand(column: Column, value):
    """Type one operand after the column it is compared with."""
    try:
        if column.type == S.TOPIC:
            return int(value)
        if column.type in (S.CONTINUOUS, S.GEOSPATIAL):
            return float(value)
        if column.type == S.BOOLEAN:
            if isinstance(value, str):
                return {"true": True, "false": False}[value.lower()]
            return bool(float(value))
        if column.type == S.TEMPORAL:
            instant = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
            return instant if instant.tzinfo else instant.replace(tzinfo=timezone.utc)
    except (KeyError, TypeError, ValueError):
        raise ValidationError(f'{value!r} is not a valid operand for {column.type} column "{column.name}"') from None
    value = str(value)
    if column.categories is not None and value not in column.categories:
        raise ValidationError(f'{value!r} is not a category of "{column.name}"')
    return value


def _range_leaf(kind: str, column: Column, ref: SparkColumn, raw) -> SparkColumn:
    value = parse_operand(column, raw)
    if column.type != S.ORDERED:
        return _COMPARE[kind](ref, F.lit(value))
    if column.categories is None:
        if column.category_order:
            raise ValidationError(f'the categories of "{column.name}" are not resolved; fit the table first')
        return _COMPARE[kind](ref, F.lit(value))  # default order is the order of the strings
    # Positions are known, so an order comparison is a membership test.
    at = column.categories.index(value)
    chosen = [c for i, c in enumerate(column.categories) if _COMPARE[kind](i, at)]
    return ref.isin(*chosen) if chosen else F.lit(False)


def _leaf(flt: Filter, schema: TableSchema, negate: bool) -> SparkColumn:
    kind = flt["type"]
    column = schema.get(flt["target"])
    if kind not in ALLOWED[column.type]:
        raise ValidationError(f'filter "{kind}" does not apply to {column.type} column "{column.name}"')
    ref = F.col(quoted(column.name))
    if kind in ("empty", "not_empty"):
        return ref.isNull() if (kind == "empty") != negate else ref.isNotNull()
    if kind in ("is_true", "is_false"):
        wanted = F.lit(kind == "is_true")
        return ~ref.eqNullSafe(wanted) if negate else ref == wanted
    if kind == "equal_to":
        wanted = F.lit(parse_operand(column, flt["value"]))
        return ~ref.eqNullSafe(wanted) if negate else ref == wanted
    if kind == "is_one_of":
        values = [parse_operand(column, v) for v in flt["values"]]
        if not values:
            return F.lit(negate)
        return (~ref.isin(*values) | ref.isNull()) if negate else ref.isin(*values)
    if kind == "has_text":
        found = ref.rlike(str(flt["value"]))
        return (~found | ref.isNull()) if negate else found
    if negate:
        return _range_leaf(_OPPOSITE[kind], column, ref, flt["value"]) | ref.isNull()
    return _range_leaf(kind, column, ref, flt["value"])


def predicate(flt: Filter | None, schema: TableSchema, negate: bool = False) -> SparkColumn:
    """The monotone formula: NULL means false. For WHERE clauses."""
    if flt is None:
        return F.lit(not negate)
    kind = flt.get("type")
    if kind == "not":
        return predicate(flt["operand"], schema, not negate)
    if kind in ("and", "or"):
        operands = [predicate(f, schema, negate) for f in flt["operands"]]
        if not operands:  # an empty list selects everything, for either connective
            return F.lit(not negate)
        if (kind == "and") != negate:
            return reduce(lambda a, b: a & b, operands)
        return reduce(lambda a, b: a | b, operands)
    if kind not in _ANY | _RANGE | _TEXT | _FLAG:
        raise ValidationError(f'"{kind}" is not a filter type')
    return _leaf(flt, schema, negate)


def to_column(flt: Filter | None, schema: TableSchema) -> SparkColumn:
    """The filter as a two-valued mask column."""
    return F.coalesce(predicate(flt, schema), F.lit(False))


def filter_table(df: DataFrame, schema: TableSchema, flt: Filter | None) -> DataFrame:
    return df if flt is None else df.filter(predicate(flt, schema))


def affected_rows(df: DataFrame, schema: TableSchema, flt: Filter | None) -> DataFrame:
    """Row ids that pass a filter, in order."""
    return filter_table(df, schema, flt).select(INDEX).orderBy(INDEX)


def both(*filters: Filter | None) -> Filter | None:
    """AND of the filters that are present."""
    present = [f for f in filters if f is not None]
    if len(present) < 2:
        return present[0] if present else None
    return {"type": "and", "operands": present}
