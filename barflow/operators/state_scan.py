"""Finite-state machines over ordered rows, in parallel within one key.

A row is a function from state to state, so a run of rows is one too.  The scan
composes the rows of every (symbol, chunk) into one such function, folds the
chunk functions of a symbol in time order to find each chunk's first state, and
then replays the chunks independently.  A symbol with a third of all rows is
thus spread over as many tasks as it has chunks, and the result is exact.

Daily rows have the month as chunk.  Rows with a time of day may be any number,
even within one day: they are numbered and cut into blocks of ``BLOCK`` rows,
the functions of ``BLOCK`` blocks are composed once more, and only these are
folded per symbol.  No list is longer than a block, but for one number per
``BLOCK * BLOCK`` rows, so the work grows in proportion to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators.segments import numbered, unbounded

BLOCK = 512


def _after(maps: Column, start: Column) -> Column:
    """States before the first and after each of the functions of a sorted list."""
    return F.aggregate(
        maps, F.array(start), lambda acc, m: F.concat(acc, F.array(F.element_at(m["_map"], F.element_at(acc, -1) + 1)))
    )


def _listed(maps: DataFrame, *by: str, chunk: str = "_chunk") -> DataFrame:
    """The functions of each group, sorted by their chunk."""
    return maps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(chunk, "_map"))).alias("_maps"))


def _firsts(maps: DataFrame, start: int, by: str = "symbol", chunk: str = "_chunk") -> DataFrame:
    """(symbol, chunk, _first): the state in which every chunk begins."""
    d = _listed(maps, by, chunk=chunk).select(by, "_maps", _after(F.col("_maps"), F.lit(start)).alias("_seen"))
    d = d.select(by, F.inline(F.arrays_zip(F.col(f"_maps.{chunk}").alias(chunk), F.col("_seen").alias("_first"))))
    return d.filter(f"{chunk} IS NOT NULL")


def _firsts_of_blocks(maps: DataFrame, start: int, states: int) -> DataFrame:
    """The same over groups of blocks, so that no list grows with the rows of a symbol."""
    grouped = _listed(maps.select("*", F.floor(F.col("_chunk") / BLOCK).alias("_group")), "symbol", "_group")
    composed = F.transform(
        F.sequence(F.lit(0), F.lit(states - 1)),
        lambda s: F.aggregate("_maps", s, lambda state, m: F.element_at(m["_map"], state + 1)),
    )
    outer = _firsts(grouped.select("symbol", "_group", composed.alias("_map")), start, chunk="_group")
    d = grouped.join(outer, ["symbol", "_group"]).select("symbol", "_maps", _after(F.col("_maps"), F.col("_first")).alias("_seen"))
    d = d.select("symbol", F.inline(F.arrays_zip(F.col("_maps._chunk").alias("_chunk"), F.col("_seen").alias("_first"))))
    return d.filter("_chunk IS NOT NULL")


def state_scan(
    df: DataFrame, code: Column, table: list[list[int]], chunk: Column | None = None, start: int = 0
) -> DataFrame:
    """Add ``state_before`` and ``state_after`` to the rows, ordered by ts per symbol.

    ``table[code][state]`` is the next state.  ``chunk`` must not decrease with
    ts; it defaults to the month for daily rows and to blocks of rows for rows
    with a time.  Several rows of one ts keep their order of ``seq`` when that
    column exists.
    """
    states = len(table[0])
    flat = ",".join(str(s) for row in table for s in row)
    lookup = F.split(F.lit(flat), ",").cast("array<int>")
    by = ["symbol", "_chunk"]
    order = ["ts"] + (["seq"] if "seq" in df.columns else [])
    blocks = chunk is None and unbounded(df)
    # The ordering fields come first, so sorting the structs sorts the rows.
    d = df.select("*", code.cast("int").alias("_code"))
    if blocks:
        place = ["_at"]
        d = numbered(d, order).select("*", F.floor(F.col("_at") / BLOCK).alias("_chunk"))
    else:
        place = order
        d = d.select("*", (F.trunc("ts", "month") if chunk is None else chunk).alias("_chunk"))
    row = F.struct(*place, F.col("_code"), F.struct(*df.columns).alias("_row"))
    runs = d.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def step(state: Column, code: Column) -> Column:
        return F.element_at(lookup, code * states + state + 1)

    composed = F.transform(
        F.sequence(F.lit(0), F.lit(states - 1)),
        lambda s: F.aggregate("_codes", s, lambda state, c: step(state, c)),
    )
    # Both uses of the runs read one exchange.
    maps = runs.select(*by, F.col("_rows._code").alias("_codes")).select(*by, composed.alias("_map"))
    firsts = _firsts_of_blocks(maps, start, states) if blocks else _firsts(maps, start)
    replay = F.aggregate(
        "_rows",
        F.array("_first"),
        lambda acc, r: F.concat(acc, F.array(step(F.element_at(acc, -1), r["_code"]))),
    )
    joined = runs.join(firsts, by).select("_rows", replay.alias("_states"))
    numbered_rows = joined.select("_states", F.posexplode("_rows").alias("_i", "_r"))
    return numbered_rows.select(
        "_r._row.*",
        F.element_at("_states", F.col("_i") + 1).alias("state_before"),
        F.element_at("_states", F.col("_i") + 2).alias("state_after"),
    )
