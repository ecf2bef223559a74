"""The audit frame: one DataFrame plus the roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_by_type(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a DataFrame, by declared type and in schema order."""
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        (numeric if isinstance(field.dataType, T.NumericType) else categorical).append(field.name)
    return numeric, categorical


@dataclass(frozen=True)
class AuditFrame:
    """Rows to audit.

    ``row_id`` must be unique where row-level results are asked for; it may be ``None`` for
    aggregate-only work. ``dense`` states that ``row_id`` already runs 0…n−1. ``proxies`` are
    columns that give the sensitive value away and may be dropped along with it. Rows without a label
    are left out, and NaN in a numeric column is a missing value.
    """

    df: DataFrame
    label: str
    sensitive: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    row_id: str | None = None
    proxies: tuple[str, ...] = ()
    dense: bool = False

    def __post_init__(self) -> None:
        missing = [c for c in self.roles() if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns not in the frame: {missing}")
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        real = [c for c in self.numeric if isinstance(kinds[c], (T.FloatType, T.DoubleType))]
        rows = self.df.filter(F.col(self.label).isNotNull())
        if real:
            rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real})
        object.__setattr__(self, "df", rows)

    def roles(self) -> list[str]:
        cols = [self.row_id] if self.row_id else []
        cols += [self.label, self.sensitive, *self.numeric, *self.categorical]
        return list(dict.fromkeys(cols))

    def features(self, include_sensitive: bool = True, drop_proxies: bool = False) -> tuple[list[str], list[str]]:
        """Numeric and categorical model inputs; blind mode leaves the sensitive column out."""
        hidden = set() if include_sensitive else {self.sensitive}
        if drop_proxies and not include_sensitive:
            hidden |= set(self.proxies)
        numeric = [c for c in self.numeric if c not in hidden]
        categorical = [c for c in self.categorical if c not in hidden]
        if include_sensitive and self.sensitive not in numeric + categorical:
            categorical.append(self.sensitive)
        return numeric, categorical

    def needs_row_id(self, what: str) -> str:
        if self.row_id is None:
            raise ValueError(f"{what} needs a unique row id column")
        return self.row_id

    def with_df(self, df: DataFrame) -> AuditFrame:
        return replace(self, df=df)
