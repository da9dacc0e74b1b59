"""Features in common stages, so that all groups share their windows.

A feature group gives its columns in six levels, each reading only earlier
ones: windows over the bars, projections, windows over those, projections,
windows again, final projections.  ``staged`` runs any set of groups level by
level.  Columns of one level with one window frame order become one window
node, and final projections are not carried through windows, so the full set
needs no more window nodes than its deepest group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from barflow.operators.layout import Ema, Rows, add, add_emas, index_rows
from barflow.operators.segments import split, unbounded

Level = Callable[[Rows, set], "dict[str, Column]"]


def nothing(r: Rows, have: set) -> dict[str, Column]:
    return {}


@dataclass(frozen=True)
class Group:
    """Levels of one feature group and the averages it needs after two of them."""

    over_bars: Level = nothing
    inputs: Level = nothing
    over_inputs: Level = nothing
    emas: tuple[Ema, ...] = ()
    middle: Level = nothing
    over_middle: Level = nothing
    late_emas: tuple[Ema, ...] = ()
    final: Level = nothing


def staged(df: DataFrame, *groups: Group) -> DataFrame:
    """Add the columns of all groups."""
    d = index_rows(df)
    for level in ("over_bars", "inputs", "over_inputs", "emas", "middle", "over_middle", "late_emas", "final"):
        if level.endswith("emas"):
            d = add_emas(d, *[e for g in groups for e in getattr(g, level)])
            continue
        r, have = Rows(d), set(d.columns)
        cols: dict[str, Column] = {}
        for g in groups:
            cols.update(getattr(g, level)(r, have))
        d = add(d, **cols)
    return d


def over_panel(bars: DataFrame, *groups: Group) -> DataFrame:
    """Add the columns of all groups to the bars of whole symbols.

    Symbols with a time of day are cut into segments for it, so that no
    partition grows with the length of a series; of the repeated rows only
    those of their own segment are returned.
    """
    if "segment" in bars.columns or not unbounded(bars):
        return staged(bars, *groups)
    return staged(split(bars), *groups).filter("_core")
