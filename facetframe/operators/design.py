"""The design-pattern table: all that a regression on group membership needs.

The regressors are 0/1 masks, so rows with the same membership pattern (and the
same target level) are interchangeable. One aggregation replaces the rows by
counts, or by counts and moments of a continuous target. The models only ever
sum functions of the pattern rows; ``PatternTable.sum`` does that on the driver
while the table is small and inside Spark tasks when it is not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import EmptyDataError, ValidationError
from ..filters import to_column
from ..schema import TableSchema, quoted
from .groups import Group, Patterns, named
from .table import is_valid

REFERENCE, BASELINE, GRAND_MEAN = "relative_to_reference", "relative_to_baseline", "grand_mean_deviation"
RESERVED = ("const", "Intercept", "Baseline")
LOCAL_PATTERNS = 50_000


def design_table(df: DataFrame, schema: TableSchema, groups, target, constrain: bool, types) -> DataFrame:
    """``pattern``, then either ``level n`` or, for a continuous target, ``n mean m2``.

    ``target`` is a column name, one group (a true/false target), or a list of
    groups (its levels, which must not overlap; rows in none are left out).
    """
    patterns = Patterns(groups, schema)
    membership = patterns.expression().alias("pattern")
    if isinstance(target, str):
        column = schema.get(target, types)
        rows = df.filter(is_valid(column))
        ref = F.col(quoted(target))
        if column.type == S.CONTINUOUS:
            rows = rows.select(membership, ref.alias("y"))
            rows = rows.filter(patterns.size() > 0) if constrain else rows
            return rows.groupBy("pattern").agg(
                F.count("y").cast("double").alias("n"), F.avg("y").alias("mean"),
                (F.var_pop("y") * F.count("y")).alias("m2"),
            )
        level, order = ref.cast("string"), column.sort_key()
        if column.type == S.BOOLEAN:
            level, order = F.when(ref, "True").otherwise("False"), ref.cast("int")
    elif isinstance(target, (list, tuple)):
        levels = Patterns(target, schema)
        rows = df.withColumn("__levels", levels.expression()).filter(levels.size("__levels") > 0)
        first = [F.when(levels.has(i, "__levels"), F.lit(i)) for i in range(len(levels))]
        order = F.coalesce(*first)
        level = F.get(F.array(*[F.lit(g.name) for g in levels.groups]), order)
        # A row in several levels shows up under an impossible level and is refused later.
        order = F.when(levels.size("__levels") > 1, F.lit(-1)).otherwise(order)
    else:
        (group,) = named([target])
        rows, mask = df, to_column(group.filter, schema)
        level, order = F.when(mask, "True").otherwise("False"), mask.cast("int")
    rows = rows.select(membership, level.alias("level"), order.alias("position"))
    rows = rows.filter(patterns.size() > 0) if constrain else rows
    return rows.groupBy("pattern", "level", "position").agg(F.count(F.lit(1)).cast("double").alias("n"))


@dataclass
class Coding:
    """Which columns the design matrix has and how a pattern becomes a row of it."""

    names: list[str]
    interpretation: str
    reference: str | None
    intercept: bool

    def __post_init__(self):
        if set(self.names) & set(RESERVED):
            raise ValidationError(f"group names must not be any of {RESERVED}")
        if self.interpretation not in (REFERENCE, BASELINE, GRAND_MEAN):
            raise ValidationError(f'"{self.interpretation}" is not an interpretation')
        if self.interpretation == GRAND_MEAN and self.reference is None:
            self.reference = self.names[-1]
        if self.interpretation == BASELINE:
            self.reference = None
        elif self.reference not in self.names:
            raise ValidationError(f'the reference {self.reference!r} is not one of the groups')
        if self.interpretation == REFERENCE and len(self.names) < 2:
            raise ValidationError("at least two groups are required")

    @property
    def variables(self) -> list[str]:
        return [n for n in self.names if n != self.reference]

    def matrix(self, bits: np.ndarray, intercept: bool | None = None) -> np.ndarray:
        bits = np.asarray(bits, dtype=float).reshape(-1, len(self.names))
        kept = [i for i, n in enumerate(self.names) if n != self.reference]
        x = bits[:, kept]
        if self.interpretation == GRAND_MEAN:
            x = x - bits[:, [self.names.index(self.reference)]]
        if self.intercept if intercept is None else intercept:
            x = np.hstack([np.ones((len(x), 1)), x])
        return x

    def profiles(self) -> tuple[list[str], np.ndarray]:
        """The baseline and one row per reported variable, as a design matrix."""
        shown = self.names if self.interpretation == GRAND_MEAN else self.variables
        x = np.zeros((1 + len(shown), len(self.variables)))
        for r, name in enumerate(shown, start=1):
            if name == self.reference:
                x[r] = -1.0
            else:
                x[r, self.variables.index(name)] = 1.0
        if self.intercept:
            x = np.hstack([np.ones((len(x), 1)), x])
        return ["Baseline", *shown], x


def _unpack(pattern: pd.Series, k: int, packed: bool) -> np.ndarray:
    if packed:
        return (pattern.to_numpy(dtype=np.int64)[:, None] >> np.arange(k)) & 1
    return np.array([[c == "1" for c in p] for p in pattern], dtype=float).reshape(-1, k)


class PatternTable:
    """A design table ready for summation."""

    def __init__(self, frame: DataFrame, patterns: Patterns):
        self.k, self.packed = len(patterns), patterns.packed
        head = frame.limit(LOCAL_PATTERNS + 1).toPandas()
        self.local = head if len(head) <= LOCAL_PATTERNS else None
        self.frame = frame if self.local is not None else frame.persist()
        if self.local is not None and self.local["n"].sum() == 0:
            raise EmptyDataError("the target has no valid rows")

    def sum(self, function) -> np.ndarray:
        """Add up ``function(bits, rows)``, a vector per batch, over all pattern rows."""
        k, packed = self.k, self.packed
        if self.local is not None:
            return np.asarray(function(_unpack(self.local["pattern"], k, packed), self.local), dtype=float)

        def partial(batches):
            total = None
            for batch in batches:
                vector = np.asarray(function(_unpack(batch["pattern"], k, packed), batch), dtype=float)
                total = vector if total is None else total + vector
            if total is not None:
                yield pd.DataFrame({"v": [total.tolist()]})

        # One vector of model size per task comes back.
        parts = self.frame.mapInPandas(partial, "v array<double>").collect()
        return np.sum([p["v"] for p in parts], axis=0)


def summarize(table: PatternTable, coding: Coding, interpretation_check: bool = True):
    """Sample size, per-group sizes, mutual exclusivity, and VIF per variable."""
    k, q = len(coding.names), len(coding.variables)

    def totals(bits, rows):
        n = rows["n"].to_numpy(dtype=float)
        x = coding.matrix(bits, intercept=True)
        weighted = x * n[:, None]
        return np.concatenate([
            [n.sum(), (n * (bits.sum(axis=1) != 1)).sum()], (bits * n[:, None]).sum(axis=0), (x.T @ weighted).ravel(),
        ])

    v = table.sum(totals)
    n, not_single, sizes = v[0], v[1], v[2:2 + k]
    if n == 0:
        raise EmptyDataError("the target has no valid rows")
    cross = v[2 + k:].reshape(q + 1, q + 1)
    exclusive = not_single == 0
    if interpretation_check:
        if coding.interpretation == BASELINE and exclusive:
            raise ValidationError("with mutually exclusive groups there is no baseline; choose a reference")
        if coding.interpretation != BASELINE and not exclusive:
            raise ValidationError("the groups must be mutually exclusive and cover all rows")
    means = cross[0, 1:] / n
    covariance = cross[1:, 1:] / n - np.outer(means, means)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    if q and (spread.min() <= 1e-12 or np.linalg.matrix_rank(covariance / np.outer(spread, spread), tol=1e-10) < q):
        raise ValidationError("the groups are linearly dependent or constant; the model cannot be identified")
    factors = np.diag(np.linalg.inv(covariance / np.outer(spread, spread))) if q else np.zeros(0)
    vif = {name: 1.0 for name in coding.names}
    vif.update(zip(coding.variables, (float(f) for f in factors)))
    info = [(name, int(size), vif[name]) for name, size in zip(coding.names, sizes)]
    return int(n), info


__all__ = ["BASELINE", "GRAND_MEAN", "REFERENCE", "Coding", "Group", "PatternTable", "design_table", "summarize"]
