"""What a check is about: feature roles, thresholds and the pair of samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, to_category, to_numeric


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of the columns of a table. Nothing in the library hard-codes a name."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    time: str | None = None

    def __post_init__(self):
        for role in ("numeric", "categorical"):
            object.__setattr__(self, role, tuple(getattr(self, role)))

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


# The two table layouts users bring along.
CENSUS = FeatureSpec(
    numeric=(
        "age",
        "fnlwgt",
        "education.num",
        "capital.gain",
        "capital.loss",
        "hours.per.week",
    ),
    categorical=(
        "workclass",
        "education",
        "marital.status",
        "occupation",
        "relationship",
        "race",
        "sex",
        "native.country",
    ),
    target="income",
)
CARD_FRAUD = FeatureSpec(
    numeric=tuple(f"V{i}" for i in range(1, 29)) + ("Amount",),
    target="Class",
    time="Time",
)


@dataclass(frozen=True)
class DriftPolicy:
    """Largest counts that are still fine; one more and the check triggers."""

    max_high_psi: int = 0
    max_ks: int = 2
    max_chi2: int = 3


@dataclass(frozen=True)
class Pair:
    """Reference and current sample in one frame.

    Two boolean columns say which sample a row belongs to. A row may be in both,
    so overlapping samples need neither a union nor a second scan, and every
    statistic of both sides is one conditional aggregate.
    """

    frame: DataFrame

    IN_REF = "_in_ref"
    IN_CUR = "_in_cur"

    @classmethod
    def of(cls, df: DataFrame, reference: Column, current: Column) -> "Pair":
        """Both samples are slices of one table."""
        in_ref = F.coalesce(reference, F.lit(False))
        in_cur = F.coalesce(current, F.lit(False))
        return cls(
            df.withColumn(cls.IN_REF, in_ref)
            .withColumn(cls.IN_CUR, in_cur)
            .where(F.col(cls.IN_REF) | F.col(cls.IN_CUR))
        )

    @classmethod
    def union(cls, reference: DataFrame, current: DataFrame) -> "Pair":
        """The samples are two tables; only the columns both have are kept.

        Where their types differ each side is coerced on its own, to numbers if the
        reference has numbers, else to text; what is not a number becomes NULL.
        """
        shared = [c for c in reference.columns if c in set(current.columns)]
        kinds = {c: (reference.schema[c].dataType, current.schema[c].dataType) for c in shared}

        def value(name: str) -> Column:
            one, other = kinds[name]
            if one == other:
                return col(name)
            coerce = to_numeric if isinstance(one, T.NumericType) else to_category
            return coerce(col(name)).alias(name)

        def side(df: DataFrame, is_ref: bool) -> DataFrame:
            return df.select(
                *[value(c) for c in shared],
                F.lit(is_ref).alias(cls.IN_REF),
                F.lit(not is_ref).alias(cls.IN_CUR),
            )

        return cls(side(reference, True).unionByName(side(current, False)))

    @property
    def reference(self) -> DataFrame:
        return self.frame.where(self.IN_REF).drop(self.IN_REF, self.IN_CUR)

    @property
    def current(self) -> DataFrame:
        return self.frame.where(self.IN_CUR).drop(self.IN_REF, self.IN_CUR)


@dataclass(frozen=True)
class Baseline:
    """Frozen bin edges of the reference sample, one ascending list per numeric feature."""

    edges: dict[str, list[float]]
    categorical: tuple[str, ...] = ()
    psi_bins: int = 10
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(self.edges)
