"""The final dataset as a query, and the same by DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions.expressions import rounded_double
from factorloom.operators import dataset
from factorloom.plans import workloads as W
from factorloom.plans.oracles import r, size_sql, trailing_sql, with_parts
from factorloom.plans.queries import barrier_sql, beta_sql
from factorloom.plans.registry import query

_SAMPLE = ["mom1m", "mom6m", "mom12m", "mom24m", "chmom", "indmom"]
_TRAIL = ["maxret", "retvol", "std_dolvol", "std_turn", "zerotrade", "dolvol", "turn", "ill", "dy", "mve"]
_BETA = {"beta": "b.beta", "betasq": "b.beta * b.beta", "idiovol": "b.idiovol"}
_INDUSTRY = ["bm_ia", "cfp_ia", "chatoia", "mve_ia", "pchcapex_ia", "chpmia", "ms"]
_FILLED = [f for f in dataset.MODEL_FEATURES if f != "age"]
_FILING = [f for f in _FILLED if f not in {*_SAMPLE, *_TRAIL, *_BETA, *_INDUSTRY}]
_RETURNS = ["return_1m", "return_2m", "return_3m"]
_LABELS = [*_RETURNS, "erp_1m", "erp_2m", "erp_3m", "ewmstd_2y_monthly", "return_tbm", "take_profit_barrier", "stop_loss_barrier"]

_columns = ", ".join([
    *(f"s.{c}" for c in ("ticker", "date", "calendardate", "datekey", "industry", "age", "timeout", "ewmstd_2y_monthly", *_SAMPLE, *_RETURNS)), *(f"t.{c}" for c in _TRAIL), f"{size_sql('t.mve')} AS size",
    *(f"CASE WHEN s.date >= f.d0 + INTERVAL 24 MONTH THEN {e} END AS {c}" for c, e in _BETA.items()), *(f"o.{c}" for c in _FILING), *(f"i.{c}" for c in _INDUSTRY),
    "x.raw AS return_tbm", "CAST(sign(x.raw) AS INT) AS primary_label_tbm", "u.up AS take_profit_barrier", "u.down AS stop_loss_barrier", *(f"s.return_{k}m - q.rate * {k} / 3 AS erp_{k}m" for k in (1, 2, 3)),
])
_moments = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in _FILLED)


NUDGE = 1.0000000003


def _draw(feature: str) -> str:
    digest = f"md5('0|' || c.ticker || '|' || CAST(c.date AS VARCHAR) || '|{feature}')"
    u, v = (f"((CAST('0x' || substr({digest}, {at}, 13) AS BIGINT) + 0.5) / 4503599627370496)" for at in (1, 17))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def _cell(f: str) -> str:
    return f"coalesce(c.{f}, CASE WHEN i.s_{f} IS NOT NULL THEN i.m_{f} + i.s_{f} * {_draw(f)} WHEN z.s_{f} IS NOT NULL THEN z.m_{f} + z.s_{f} * {_draw(f)} ELSE {_draw(f)} END)"


def _digits(x: str, name: str) -> str:
    """Six significant digits, as features differ widely in size; 0 below a millionth. The nudge takes ties of short decimals one way."""
    return f"CASE WHEN abs({x}) < 1e-6 THEN 0.0 ELSE CAST(printf('%.5e', {x} * {NUDGE}) AS DOUBLE) END AS {name}"


def digits(c: str) -> Column:
    return F.when(F.abs(c) < 1e-6, 0.0).when(F.col(c).isNotNull(), F.format_string("%.5e", F.col(c) * NUDGE).cast("double")).alias(c)


#: CTEs up to filled_, the finished rows
TRAINING_ROWS_SQL = (
    with_parts("walked", "priced", "monthly", "industries", "rates") + beta_sql("walked").replace("FROM walked s", "FROM walked s")
    + ", chosen AS (SELECT p.*, e.ewmstd AS ewmstd_2y_monthly FROM priced p JOIN walked USING (ticker, date) LEFT JOIN ewm e ON e.ticker = p.ticker AND e.month = last_day(p.date - INTERVAL 1 MONTH))"
    + barrier_sql("chosen", 1.0, -1.0, "1")
    + f""", trail AS ({trailing_sql()}), once AS (SELECT * FROM featured QUALIFY row_number() OVER (PARTITION BY ticker, datekey ORDER BY calendardate DESC) = 1),
merged AS (SELECT {_columns} FROM chosen s JOIN trail t ON t.ticker = s.ticker AND t.date = s.date JOIN first f ON f.ticker = s.ticker JOIN once o ON o.ticker = s.ticker AND o.datekey = s.datekey
  JOIN industries i ON i.ticker = o.ticker AND i.datekey = o.datekey AND i.calendardate = o.calendardate LEFT JOIN b ON b.ticker = s.ticker AND b.date = s.date LEFT JOIN touch u ON u.ticker = s.ticker AND u.date = s.date
  LEFT JOIN path x ON x.ticker = u.ticker AND x.date = u.date AND x.t = u.touch LEFT JOIN rates q ON q.date = s.date),
whole AS (SELECT * FROM merged WHERE size IS NOT NULL AND industry IS NOT NULL), z AS (SELECT size, {_moments} FROM whole GROUP BY size),
c AS (SELECT * FROM whole WHERE mom24m IS NOT NULL AND primary_label_tbm IS NOT NULL AND return_1m IS NOT NULL AND erp_1m IS NOT NULL AND age <= 180), i AS (SELECT industry, size, {_moments} FROM c GROUP BY industry, size),
filled_ AS (SELECT c.ticker, c.date, c.calendardate, c.datekey, c.industry, c.size, c.timeout, c.primary_label_tbm, CAST(sign(c.erp_1m) AS INT) AS erp_1m_direction, CAST(c.age AS DOUBLE) AS age, {", ".join(f"{_cell(f)} AS {f}" for f in _FILLED)}, {", ".join(r(f"c.{f}", 6, f) for f in _LABELS)}
  FROM c LEFT JOIN i USING (industry, size) LEFT JOIN z ON z.size = c.size WHERE c.primary_label_tbm <> 0 AND c.erp_1m <> 0)
"""
)
TRAINING_SQL = TRAINING_ROWS_SQL + f"""SELECT * REPLACE ({", ".join(_digits(f, f) for f in _FILLED)}) FROM filled_"""


@query(TRAINING_SQL, 12)
def training_table(spark, d):
    """The final dataset: base columns, the features of the models with nulls drawn, labels."""
    out = dataset.ordered(W.training_table(spark, d))
    return out.select(*[digits(c) if c in _FILLED else rounded_double(F.col(c), 6).alias(c) if c in _LABELS else F.col(c) for c in out.columns])

