"""Functions of one group's tables: a main table and any number of side tables with the same key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: (key values, main rows, side rows by name) -> rows
Callback = Callable[[tuple, pa.Table, dict[str, pa.Table]], pa.Table]


def with_sides(main: DataFrame, sides: dict[str, DataFrame], key: list[str], function: Callback, schema: str, order: dict[str, list[str]] | None = None, only_main: bool = True) -> DataFrame:
    """Apply ``function`` to every key's rows of ``main`` and of each side table, all in Arrow; what it returns is cast to ``schema``.

    Main and sides are shuffled by the key once each: the sides travel together, each in a struct column of its own, so their columns may
    have clashing names. ``order`` names columns by which a table (``main`` or a side's name) is sorted before the call. Tables without rows of a
    key come empty, with their schema; keys that ``main`` doesn't have are left out unless ``only_main`` is False. Null keys are a group. A
    group is in memory as a whole, so the key must bound it (a ticker, a ticker and year): steps that can run in order
    use ``groupBy().applyInArrow`` over batches instead, as ``sampling.sample_at_filings`` does.
    """
    order = order or {}
    packed = [t.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.lit(n).alias("_side"), F.struct(*t.columns).alias(f"_s_{n}")) for n, t in sides.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    names = list(sides)

    def sorted_by(t: pa.Table, name: str) -> pa.Table:
        return t.sort_by([(c, "ascending") for c in order[name]]) if name in order else t

    def call(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if only_main and not left.num_rows:
            return pa.Table.from_pylist([], schema=empty)
        tables = {}
        for n in names:
            rows = right.filter(pc.equal(right.column("_side"), n)).column(f"_s_{n}").combine_chunks()
            struct = rows if isinstance(rows, pa.StructArray) else pa.concat_arrays(rows.chunks or [pa.array([], rows.type)])
            tables[n] = sorted_by(pa.Table.from_arrays(struct.flatten(), names=[f.name for f in struct.type]), n)
        return function(tuple(x.as_py() for x in k), sorted_by(left, "main"), tables).select(empty.names).cast(empty)

    empty = to_arrow_schema(main.sparkSession.createDataFrame([], schema).schema)
    return main.groupBy(*key).cogroup(every.groupBy(*[f"_k{i}" for i in range(len(key))])).applyInArrow(call, schema)


def trailing_stops(samples: DataFrame, bars: DataFrame, filings: DataFrame, fall: float = 0.3) -> DataFrame:
    """(ticker, date, stops, drawdown) of each sample: how often a trailing stop has fired since the last new filing.

    The stop follows the highest close since it was set and fires on a close ``fall`` or more below; it is set anew by the close that
    fires it and by the first close on or after a filing's datekey. drawdown is the close over the stop's peak, less 1. Where the stop is set depends on every
    firing before, which no window frame can say. Samples on days without a bar take the last bar before, none before the first.
    """

    def walk(k: tuple, main: pa.Table, sides: dict[str, pa.Table]) -> pa.Table:
        days, closes = sides["bars"].column("date").to_pylist(), sides["bars"].column("close").to_pylist()
        filed = [x for x in sides["filings"].column("datekey").to_pylist() if x is not None]
        asked = [x for x in main.column("date").to_pylist() if x is not None]
        out: list[tuple] = []
        peak = last = None
        stops = i = j = 0
        for day, close in [*((d, c) for d, c in zip(days, closes) if d is not None and c is not None), (None, None)]:
            while j < len(asked) and (day is None or asked[j] < day):
                out.append((k[0], asked[j], stops if last is not None else None, last / peak - 1 if last is not None and peak else None))
                j += 1
            if day is None:
                break
            new = False
            while i < len(filed) and filed[i] <= day:
                new, i = True, i + 1
            if peak is None or new:
                peak, stops = close, 0
            elif close <= peak * (1 - fall):
                peak, stops = close, stops + 1
            peak, last = max(peak, close), close
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.date32(), pa.int32(), pa.float64()))], names=["ticker", "date", "stops", "drawdown"])

    sides = {"bars": bars.select("ticker", "date", "close"), "filings": filings.select("ticker", "datekey")}
    return with_sides(samples.select("ticker", "date"), sides, ["ticker"], walk, "ticker string, date date, stops int, drawdown double", {"main": ["date"], "bars": ["date"], "filings": ["datekey"]})
