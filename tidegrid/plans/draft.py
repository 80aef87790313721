"""Sharing window passes between feature packs.

A pack adds columns in a few dependent stages, and every stage is one projection with one pass per
window sort. Packs that do not need each other are drafted first and their stages merged level by
level, so a dozen packs cost as many passes over the (wide) rows as the deepest of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tidegrid.functions.ordered import with_columns


class Draft:
    """Records the stages a pack would add to a frame with these columns."""

    def __init__(self, columns: list[str]):
        self.columns = list(columns)
        self.stages: list[dict[str, Column]] = []

    def withColumns(self, exprs: dict[str, Column]) -> "Draft":  # noqa: N802 - DataFrame's name
        if exprs:
            self.stages.append(dict(exprs))
            self.columns += [c for c in exprs if c not in self.columns]
        return self

    def withColumn(self, name: str, expr: Column) -> "Draft":  # noqa: N802
        return self.withColumns({name: expr})

    def drop(self, *names: str) -> "Draft":
        self.columns = [c for c in self.columns if c not in names]
        return self


def together(df: DataFrame, packs: list[Callable]) -> DataFrame:
    """Apply independent packs with merged stages and drop their helper columns (leading ``_``).

    Two packs may define the same helper only in the same way."""
    drafts = [Draft(df.columns) for _ in packs]
    for pack, draft in zip(packs, drafts):
        pack(draft)
    for level in range(max((len(d.stages) for d in drafts), default=0)):
        merged: dict[str, Column] = {}
        for d in drafts:
            if level < len(d.stages):
                merged.update(d.stages[level])
        df = with_columns(df, merged)
    return df.drop(*[c for c in df.columns if c.startswith("_")])
