"""Ranges of ids in ascending order, found from the ids alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

#: Ids that are looked at for each range, where quantiles can't be counted.
_SAMPLE = 20


@dataclass(frozen=True)
class IdRanges:
    """Bounds are ids of the table, so each range but the first begins with a row; nulls come first.

    Ids are numbers or texts.  Quantiles of numbers are counted over all rows; for texts they are those of the
    ids of least hash, twenty for each range.  Either way ranges cover every row and differ in size alone.
    """

    bounds: list
    least: object
    nulls: int
    kind: DataType

    @classmethod
    def of(cls, df: DataFrame, col: str, parts: int) -> IdRanges:
        kind = df.schema[col].dataType
        facts = [F.min(col).alias("least"), F.count_if(F.col(col).isNull()).alias("nulls")]
        if isinstance(kind, NumericType):
            facts.append(F.percentile_approx(col, [k / parts for k in range(1, parts)] or [0.5], _SAMPLE * parts).alias("cuts"))
            at = df.agg(*facts).first()
            cuts = at.cuts or []
        else:
            at = df.agg(*facts).first()
            seen = sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).orderBy(F.xxhash64(col), col).limit(_SAMPLE * parts).collect())
            cuts = [seen[len(seen) * k // parts] for k in range(1, parts)] if seen else []
        return cls(sorted({b for b in cuts if b > at.least or at.nulls}), at.least, at.nulls, kind)

    def _array(self) -> F.Column:
        """The bounds as one literal."""
        return F.from_json(F.lit(json.dumps([b if isinstance(b, (int, float)) else str(b) for b in self.bounds])), f"array<{self.kind.simpleString()}>")

    def part(self, col: str) -> F.Column:
        """Number of bounds at or below the id, by halving."""
        if not self.bounds:
            return F.lit(0)
        steps, bounds, n = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.bounds).bit_length()))]), self._array(), len(self.bounds)
        halve = lambda at, step: F.when((at + step <= n) & (F.get(bounds, F.least(at + step, F.lit(n)) - 1) <= F.col(col)), at + step).otherwise(at)
        return F.when(F.col(col).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), halve)).cast("int")

    def at_bound(self, col: str, part: F.Column) -> F.Column:
        """Whether the id, of range ``part``, is the bound with which the range begins."""
        return F.coalesce(F.get(self._array(), part - 1) == F.col(col), F.lit(False)) if self.bounds else F.lit(False)

    def is_first(self, col: str) -> F.Column:
        return F.col(col).isNull() if self.nulls else F.col(col) == F.lit(self.least)


def range_parts(df: DataFrame) -> int:
    """Ranges to make: four for each shuffle partition, so that the dealing evens out."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
