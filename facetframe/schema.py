"""Semantic column types and the table schema.

A table is an ordinary DataFrame. A :class:`TableSchema` next to it says what
each column *means*; the meaning decides how a column is fitted, compared,
sorted and counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from .errors import ValidationError

INDEX = "__index"

CONTINUOUS = "continuous"
CATEGORICAL = "categorical"
ORDERED = "ordered-categorical"
TEMPORAL = "temporal"
TEXTUAL = "textual"
UNIQUE = "unique"
GEOSPATIAL = "geospatial"
BOOLEAN = "boolean"
TOPIC = "topic"

ALL_TYPES = (CONTINUOUS, CATEGORICAL, ORDERED, TEMPORAL, TEXTUAL, UNIQUE, GEOSPATIAL, BOOLEAN, TOPIC)
CATEGORICAL_FAMILY = (CATEGORICAL, ORDERED, TEMPORAL, TOPIC, BOOLEAN)
ORDERED_FAMILY = (TEMPORAL, CONTINUOUS, ORDERED)
ORDERED_CATEGORICAL_FAMILY = (TEMPORAL, ORDERED)
ANALYZABLE = (CATEGORICAL, CONTINUOUS, ORDERED, TEMPORAL, TOPIC, BOOLEAN)

# The calendar labels, in their natural order.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
DAYS_OF_WEEK = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
HOURS = tuple(f"{h:02d}:00" for h in range(24))

TEMPORAL_FEATURES = {
    "year": "Year",
    "month": "Month",
    "date": "Date",
    "monthly": "Monthly",
    "day_of_week": "Day of Week",
    "hour": "Hour",
}


@dataclass(frozen=True)
class Column:
    """One typed column. Options that do not apply to ``type`` are ignored."""

    name: str
    type: str
    min_frequency: int = 0
    category_order: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None  # resolved order, filled in by fit
    datetime_format: str | None = None
    temporal_features: tuple[str, ...] = ()
    temporal_precision: str | None = None
    role: str | None = None  # geospatial: latitude | longitude
    internal: bool = False
    source_name: str | None = None

    def __post_init__(self):
        if self.type not in ALL_TYPES:
            raise ValidationError(f'"{self.type}" is not a column type')
        if self.type == GEOSPATIAL and self.role not in ("latitude", "longitude"):
            raise ValidationError(f'geospatial column "{self.name}" needs role latitude or longitude')
        unknown = set(self.temporal_features) - set(TEMPORAL_FEATURES)
        if unknown:
            raise ValidationError(f"unknown temporal features {sorted(unknown)}")

    def derived(self) -> list["Column"]:
        """The internal columns that fitting adds right after this one."""
        if self.internal:
            return []
        if self.type == TEXTUAL:
            return [
                Column(f"{self.name} (Preprocessed)", UNIQUE, internal=True, source_name=self.name),
                Column(f"{self.name} (Topic)", TOPIC, internal=True, source_name=self.name),
            ]
        if self.type != TEMPORAL:
            return []
        columns = []
        for feature, label in TEMPORAL_FEATURES.items():
            if feature not in self.temporal_features:
                continue
            name = f"{self.name} ({label})"
            if feature in ("year", "month", "date"):
                columns.append(
                    Column(name, TEMPORAL, temporal_precision=feature, internal=True, source_name=self.name)
                )
            else:
                order = {"monthly": MONTHS, "day_of_week": DAYS_OF_WEEK, "hour": HOURS}[feature]
                columns.append(
                    Column(name, ORDERED, category_order=order, categories=order, internal=True, source_name=self.name)
                )
        return columns

    def sort_key(self, value: SparkColumn | None = None) -> SparkColumn:
        """An expression whose natural order is the order of this column.

        Ordered categories sort by position; with no resolved positions the
        declared order is used and undeclared values come first, by name.
        """
        value = F.col(quoted(self.name)) if value is None else value
        if self.type != ORDERED:
            return value
        order = self.categories or self.category_order
        if not order:
            return value
        position = F.array_position(F.array(*[F.lit(c) for c in order]), value)
        if self.categories:
            return position
        return F.when(value.isNotNull(), F.struct(position, value))

    def numeric_key(self, value: SparkColumn | None = None) -> SparkColumn:
        """A DOUBLE with the order of this column, for rank statistics."""
        value = F.col(quoted(self.name)) if value is None else value
        if self.type == TEMPORAL:
            return F.unix_micros(value.cast("timestamp")).cast("double")
        if self.type == ORDERED:
            if not self.categories:
                raise ValidationError(f'the categories of "{self.name}" are not resolved; fit the table first')
            return self.sort_key(value).cast("double")
        return value.cast("double")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[Column, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValidationError("column names must be unique")

    @staticmethod
    def of(*columns: Column) -> "TableSchema":
        return TableSchema(tuple(columns))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def get(self, name: str, types: tuple[str, ...] | None = None) -> Column:
        for column in self.columns:
            if column.name == name:
                if types is not None and column.type not in types:
                    raise ValidationError(f'column "{name}" is {column.type}; expected one of {", ".join(types)}')
                return column
        raise ValidationError(f'column "{name}" does not exist')

    def require_textual(self) -> "TableSchema":
        """A dataset meant for topic work needs at least one textual column."""
        if not any(c.type == TEXTUAL for c in self.columns):
            raise ValidationError("at least one textual column is required")
        return self

    def with_derived(self) -> "TableSchema":
        """Derived columns inserted right after their parents, stale ones removed."""
        known = {c.name: c for c in self.columns if c.internal}
        columns: list[Column] = []
        for column in self.columns:
            if column.internal:
                continue
            columns.append(column)
            columns.extend(known.get(d.name, d) for d in column.derived())
        return TableSchema(tuple(columns))

    def replacing(self, column: Column) -> "TableSchema":
        return TableSchema(tuple(column if c.name == column.name else c for c in self.columns))

    def resolved(self, name: str, categories) -> "TableSchema":
        return self.replacing(replace(self.get(name), categories=tuple(categories)))
