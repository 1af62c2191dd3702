"""Ordered cleaning steps over a DataFrame, with history."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators import anomalies, dedup, impute, pii, schema
from ..session import cut_lineage
from ..sources.readers import read_any

Step = Callable[[DataFrame], DataFrame]


class StepError(Exception):
    """A step failed; `history` holds the frames of the steps before it."""

    def __init__(self, name: str, error: Exception, history: list[tuple[str, DataFrame]]) -> None:
        super().__init__(f"step '{name}' failed: {error}")
        self.name, self.history = name, history


def normalize_step(df: DataFrame) -> DataFrame:
    return df.toDF(*[schema.snake_case_acronym(c) for c in df.columns])


BUILTIN: dict[str, Step] = {
    "deduplicate": lambda df: dedup.remove_duplicates(df),
    "impute_missing": impute.impute_default,
    "detect_anomalies": anomalies.iqr_flags,
    "mask_pii": pii.mask_by_name,
    "normalize_schema": normalize_step,
}


class CleaningSteps:
    """Run named steps in order. Frames are lazy, so history and rollback copy nothing.

    Set `checkpoint=True` to materialise after every step, which also ties runtime errors to
    the step that caused them.
    """

    def __init__(self, steps: Sequence[str], custom: Mapping[str, Step] | None = None,
                 checkpoint: bool = False) -> None:
        self.steps, self.custom = list(steps), dict(custom or {})
        self.checkpoint = checkpoint
        self.history: list[tuple[str, DataFrame]] = []

    def add_step(self, name: str, step: Step) -> None:
        self.custom[name] = step

    def available_steps(self) -> list[str]:
        return [*BUILTIN, *self.custom]

    def run(self, df: DataFrame) -> DataFrame:
        self.history = [("start", df)]
        for name in self.steps:
            step = self.custom.get(name) or BUILTIN.get(name)
            try:
                if step is None:
                    raise ValueError("not a known step")
                out = step(self.history[-1][1])
                out = cut_lineage(out) if self.checkpoint else out
            except Exception as error:
                raise StepError(name, error, self.history) from error
            self.history.append((name, out))
        return self.history[-1][1]

    def rollback(self, steps: int = 1) -> DataFrame:
        """Drop the last steps from the history and return the frame before them."""
        keep = max(1, len(self.history) - steps)
        self.history = self.history[:keep]
        return self.history[-1][1]


def run_cleaning(spark, path: str, fmt: str | None = None, drop_duplicates: bool = False,
                 fillna: str | None = None, columns: Sequence[str] | str | None = None,
                 order_by: Sequence[str] = ()) -> DataFrame:
    """Read a file, select, drop duplicates, fill missing values, normalise the names."""
    df = read_any(spark, path, fmt)
    if columns:
        df = schema.select_columns(df, columns)
    if drop_duplicates:
        df = dedup.remove_duplicates(df)
    if fillna:
        df = impute.Imputer(fillna, order_by=order_by).fit_transform(df)
    return schema.normalize_columns(df)
