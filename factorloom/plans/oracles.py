"""DuckDB SQL that computes the queries' results by other means."""

from __future__ import annotations

from factorloom.operators.dataset import SIZE_BOUNDS, SMALLEST
from factorloom.plans.formulas import FORMULAS, INDUSTRY, INDUSTRY_STEPS, STEPS, parsed
from factorloom.sources.adapters import INPUTS, STATEMENTS
from factorloom.sources.readers import FILING_VALUES


def _asof(value: str, days: int) -> str:
    bound = f"INTERVAL {-days} DAYS PRECEDING" if days <= 0 else f"INTERVAL {days} DAYS FOLLOWING"
    return f"last_value({value}) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND {bound})"


def _change(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0) - 1"


_V = {d: _asof("adj_close", d) for d in (0, -7, -30, -182, -212, -365, -730, 30, 60, 90)}
_RETURNS = {
    "mom1w": _change(_V[0], _V[-7]), "mom12m_actual": _change(_V[0], _V[-365]), "mom1m": _change(_V[0], _V[-30]), "mom6m": _change(_V[-30], _V[-182]),
    "mom12m": _change(_V[-30], _V[-365]), "mom24m": _change(_V[0], _V[-730]), "mom12m_to_7m": _change(_V[-212], _V[-365]),
    **{f"return_{k}m": f"CASE WHEN date + {30 * k} <= max(date) OVER (PARTITION BY ticker) THEN {_change(_V[30 * k], 'adj_close')} END" for k in (1, 2, 3)},
    "timeout": "CAST(max(date) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 29 DAYS FOLLOWING) AS DATE)",
}
_PAID = "coalesce((close + coalesce(dividends, 0)) / nullif(close, 0), 1)"


def _month_frame(months: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL {months} MONTH PRECEDING AND CURRENT ROW)"


def _trailing() -> str:
    m1, m2, m3, y = (_month_frame(n) for n in (1, 2, 3, 12))
    ret, dollars, turn = "(close / open - 1)", "((open + close) / 2 * volume)", "(volume / nullif(sharesbas, 0))"
    cap = "(sharesbas * sharefactor * close)"
    cells = {
        "maxret": (1, f"max({ret}) {m1}"), "retvol": (1, f"stddev_samp({ret}) {m1}"), "std_dolvol": (1, f"stddev_samp({dollars}) {m1} * sqrt(22)"), "std_turn": (1, f"stddev_samp({turn}) {m1} * sqrt(22)"),
        "zerotrade": (1, f"(count(*) FILTER (WHERE volume = 0) {m1} + 1 / (sum(volume) {m1} / avg(sharesbas) {m1}) / (11000.0 / 12)) * 21 / count(*) {m1}"),
        "dolvol": (2, f"ln(sum(close * volume) {m2})"), "turn": (3, f"sum(volume) {m3} / 3 / nullif(sharesbas, 0)"), "ill": (12, f"avg(abs({ret}) / nullif({dollars}, 0)) {y}"), "dy": (12, f"sum(dividends) {y} / nullif({cap}, 0)"),
    }
    gated = ", ".join(f"CASE WHEN date >= min(date) OVER (PARTITION BY ticker) + INTERVAL {n} MONTH THEN {e} END AS {k}" for k, (n, e) in cells.items())
    return f"SELECT ticker, date, {gated}, CASE WHEN {cap} > 0 THEN ln({cap}) END AS mve FROM known"


def _fundamentals() -> str:
    v = ", ".join(f"'{c}': f.{c}" for c in FILING_VALUES)
    quarters = ", ".join(f"arg_max({{{v}}}, f.datekey) FILTER (WHERE f.qidx = c.qidx - {i}) AS q{i}" for i in range(8))
    steps = ", ".join(f"{e} AS {k}" for k, e in parsed(STEPS).items())
    cells = ", ".join(f"CASE WHEN ready THEN {e} END AS {k}" for k, e in parsed(FORMULAS).items())
    return f"""
w AS (SELECT c.ticker, c.calendardate, c.datekey, arg_max({{{v}}}, f.datekey) FILTER (WHERE f.qidx = c.qidx - 4) AS p, {quarters}
      FROM filled c JOIN filled f ON f.ticker = c.ticker AND f.qidx BETWEEN c.qidx - 7 AND c.qidx AND f.datekey <= c.datekey GROUP BY ALL),
x AS (SELECT c.*, m.industry, m.firstpricedate, w.* EXCLUDE (ticker, calendardate, datekey), c.calendardate >= last_day(min(c.calendardate) OVER (PARTITION BY c.ticker) + INTERVAL 12 MONTH) AS ready
      FROM filled c JOIN w USING (ticker, calendardate, datekey) JOIN metadata m ON m.ticker = c.ticker),
stepped AS (SELECT *, {steps} FROM x),
featured AS (SELECT {", ".join(["ticker", "calendardate", "datekey", "is_filled", "industry", *FILING_VALUES])}, {cells} FROM stepped)"""


def _industry() -> str:
    steps = parsed(INDUSTRY_STEPS)
    means = ", ".join(f"avg({k}) AS {k}" for k in steps)
    return f"""
own AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in steps.items())} FROM featured WHERE industry IS NOT NULL),
means AS (SELECT industry, calendardate, {means}, CASE WHEN bool_or(revenueusd IS NULL) THEN NULL ELSE sum(revenueusd * revenueusd) / nullif(sum(revenueusd) * sum(revenueusd), 0) END AS herf
          FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY industry, calendardate, ticker ORDER BY datekey) = 1) GROUP BY ALL),
industries AS (SELECT own.ticker, own.calendardate, own.datekey, {", ".join(f"{e} AS {k}" for k, e in parsed(INDUSTRY).items())}
          FROM own JOIN means AS m ON m.industry = own.industry AND m.calendardate = own.calendardate)"""


def _size(x: str = "mve") -> str:
    whens = " ".join(f"WHEN {x} >= ln({b}) THEN '{n}'" for n, b in reversed(SIZE_BOUNDS.items()))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{SMALLEST}' END"


_SIDE = "CASE WHEN direction > 0 THEN {a}_return ELSE {b}_return END"

#: named parts, in an order in which each uses earlier ones only
PARTS: dict[str, str] = {n: f"{n} AS ({s.format(**{t: t for t in INPUTS}).strip()})" for n, s in STATEMENTS.items()}
PARTS["pit"] = """pit AS (SELECT b.*, k.calendardate, k.datekey, k.sharesbas, k.sharefactor, b.date - k.datekey AS age
  FROM (SELECT b.ticker, b.date, max({'calendardate': f.calendardate, 'datekey': f.datekey, 'sharesbas': f.sharesbas, 'sharefactor': f.sharefactor}) AS k
        FROM bars b JOIN filings f ON f.ticker = b.ticker AND f.datekey <= b.date GROUP BY ALL) g JOIN bars b ON b.ticker = g.ticker AND b.date = g.date)"""
PARTS["known"] = "known AS (SELECT pit.*, industry, sector, siccode FROM pit JOIN metadata USING (ticker))"
PARTS["adj"] = f"adj AS (SELECT *, close / coalesce(product({_PAID}) OVER (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS adj_close FROM known)"
PARTS["rets"] = f"rets AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _RETURNS.items())} FROM adj)"
PARTS["priced"] = """priced AS (SELECT rets.*, mom6m - mom12m_to_7m AS chmom, mom1w_ewa_market, indmom FROM rets
  JOIN (SELECT date, avg(mom1w) AS mom1w_ewa_market FROM rets GROUP BY date) USING (date)
  JOIN (SELECT industry, date, avg(mom12m_actual) AS indmom FROM rets GROUP BY ALL) USING (industry, date))"""
PARTS["monthly"] = """months AS (SELECT ticker, CAST(last_day(CAST(m AS DATE)) AS DATE) AS month FROM (SELECT ticker, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM adj GROUP BY ticker)),
monthly AS (SELECT m.ticker, m.month, a.adj_close / nullif(b.adj_close, 0) - 1 AS x FROM months m ASOF LEFT JOIN adj a ON a.ticker = m.ticker AND a.date <= m.month
  ASOF LEFT JOIN (SELECT ticker, date + 30 AS date, adj_close FROM adj) b ON b.ticker = m.ticker AND b.date <= m.month),
ewm AS (SELECT ticker, month, CASE WHEN count(x) > 1 THEN sqrt(greatest(0, (sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w))) * sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w)))) END AS ewmstd
  FROM (SELECT a.ticker, a.month, b.x, CASE WHEN b.x IS NOT NULL THEN pow(1 - 2.0 / 25, datediff('month', b.month, a.month)) END AS w FROM monthly a JOIN monthly b ON b.ticker = a.ticker AND b.month <= a.month) GROUP BY ALL)"""
PARTS["sampled"] = """sampled AS (SELECT s.*, e.ewmstd AS ewmstd_2y_monthly FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1) s
  LEFT JOIN ewm e ON e.ticker = s.ticker AND e.month = last_day(s.date - INTERVAL 1 MONTH))"""
PARTS["filled_days"] = """filled_days AS (SELECT b.ticker, CAST(d.day AS DATE) AS date, b.open, b.high, b.low, b.close, b.volume, b.dividends, b.date = CAST(d.day AS DATE) AS can_trade
  FROM (SELECT ticker, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM bars GROUP BY ticker) d ASOF JOIN bars b ON b.ticker = d.ticker AND b.date <= d.day)"""
PARTS["rates"] = """rates AS (SELECT CAST(d.day AS DATE) AS date, round(b.percent / 100, 4) AS rate FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM bills) d
  ASOF LEFT JOIN (SELECT * FROM bills WHERE percent IS NOT NULL) b ON b.date <= d.day)"""
PARTS["filled"] = """filled AS (SELECT f.* EXCLUDE (calendardate, gap), CAST(last_day(f.calendardate + to_months(CAST(3 * k AS INTEGER))) AS DATE) AS calendardate, qidx + k AS qidx_, k > 0 AS is_filled
  FROM (SELECT *, coalesce(lead(qidx) OVER (PARTITION BY ticker ORDER BY calendardate, datekey) - qidx, 1) AS gap FROM (SELECT *, year(calendardate) * 4 + quarter(calendardate) - 1 AS qidx FROM filings)) f,
       (SELECT unnest(range(0, 4)) AS k) WHERE k <= greatest(0, least(3, gap - 1)))""".replace("qidx + k AS qidx_", "qidx + k AS qidx").replace("EXCLUDE (calendardate, gap)", "EXCLUDE (calendardate, gap, qidx)")
PARTS["featured"] = _fundamentals().strip()
PARTS["industries"] = _industry().strip()
PARTS["walked"] = """days AS MATERIALIZED (SELECT ticker, date, datekey, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM known),
walk AS (SELECT ticker, i, date, datekey, CAST(date + INTERVAL 1 MONTH AS DATE) AS target, date AS before, date AS last, date AS taken, CAST(NULL AS DATE) AS dropped FROM days WHERE i = 1
  UNION ALL SELECT ticker, i, date, datekey, CASE WHEN filed THEN CAST(date + INTERVAL 1 MONTH AS DATE) WHEN date >= target THEN CAST(target + INTERVAL 1 MONTH AS DATE) ELSE target END, CASE WHEN filed THEN before ELSE date END,
    coalesce(taken, last), taken, CASE WHEN filed AND last > date - 20 THEN last END
  FROM (SELECT *, CASE WHEN filed OR date = target THEN date WHEN date > target THEN CASE WHEN target - before > date - target THEN date ELSE before END END AS taken
        FROM (SELECT d.*, w.target, w.before, w.last, d.datekey <> w.datekey AS filed FROM walk w JOIN days d ON d.ticker = w.ticker AND d.i = w.i + 1))),
walked AS (SELECT ticker, day AS date FROM (SELECT ticker, taken AS day, 1 AS n FROM walk WHERE taken IS NOT NULL UNION ALL SELECT ticker, dropped, -1 FROM walk WHERE dropped IS NOT NULL) GROUP BY ALL HAVING sum(n) > 0)"""
PARTS["actions"] = """ended AS (SELECT ticker, max(date) AS date FROM bars GROUP BY ticker HAVING max(date) < (SELECT max(date) FROM bars)),
actions AS (SELECT ticker, min(date) AS date, CASE WHEN bool_or(b) THEN 'bankruptcy' ELSE 'delisted' END AS action
  FROM (SELECT ticker, date, true AS b FROM corp_events WHERE list_contains(string_split(eventcodes, '|'), '13') UNION ALL SELECT ticker, date, false FROM ended) GROUP BY ticker)"""
PARTS["scored"] = """scored AS (SELECT ticker, date, CASE WHEN mom1w > 0 THEN 1 ELSE -1 END AS side, round(0.5 + least(0.49, greatest(0.01, abs(mom1w) / 10)), 9) AS certainty, ewmstd_2y_monthly AS ewmstd
  FROM sampled WHERE mom1w IS NOT NULL AND ewmstd_2y_monthly IS NOT NULL)"""
PARTS["numbered"] = "numbered AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS signal_id FROM scored)"
PARTS["rebalanced"] = """fridays AS (SELECT date FROM filled_days WHERE isodow(date) = 5 GROUP BY date HAVING bool_or(can_trade)),
candidates AS (SELECT d.date AS rebalance, n.* FROM fridays d JOIN numbered n ON n.date BETWEEN d.date - 7 AND d.date - 1),
best AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY rebalance, side ORDER BY certainty DESC, signal_id) <= CASE WHEN side > 0 THEN 15 ELSE 6 END),
rebalanced AS (SELECT b.rebalance, b.signal_id, b.ticker, b.side AS direction, b.certainty, b.ewmstd, b.date AS features_date FROM best b JOIN filled_days f ON f.ticker = b.ticker AND f.date = b.rebalance
  LEFT JOIN actions a ON a.ticker = b.ticker WHERE f.can_trade AND coalesce(f.date < a.date, true))"""
PARTS["trades"] = """trades AS (SELECT CAST(ticker AS BIGINT) * 1000000 + year(date) * 100 + month(date) AS order_id, ticker, CASE WHEN (month(date) + year(date) + CAST(ticker AS INT)) % 3 = 0 THEN -1 ELSE 1 END AS direction,
  CAST(CASE WHEN (month(date) + year(date) + CAST(ticker AS INT)) % 3 = 0 THEN -1 ELSE 1 END * ((month(date) + year(date) + CAST(ticker AS INT)) % 7 + 1) * 10 AS DOUBLE) AS amount, close AS fill_price, date + 1 AS trade_date, date + 28 AS timeout, 0.6 AS take_profit, -0.4 AS stop_loss
  FROM bars QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1)"""
PARTS["paths"] = """paths AS (SELECT *, ((low + paid) / fill_price - 1) * direction AS low_return, ((high + paid) / fill_price - 1) * direction AS high_return, ((close + paid) / fill_price - 1) * direction AS close_return
  FROM (SELECT t.*, b.date AS day, b.open, b.high, b.low, b.close, b.dividends, sum(b.dividends) OVER (PARTITION BY order_id ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS paid
        FROM trades t JOIN bars b ON b.ticker = t.ticker AND b.date BETWEEN t.trade_date AND t.timeout))"""
PARTS["exits"] = f"""judged AS (SELECT p.*, CAST({_SIDE.format(a="low", b="high")} AS DOUBLE) <= stop_loss AS stopped, CAST({_SIDE.format(a="high", b="low")} AS DOUBLE) >= take_profit AS took, (open <= close) = (direction > 0) AS stop_first, a.action
  FROM paths p LEFT JOIN actions a ON a.ticker = p.ticker AND a.date = p.day),
caused AS (SELECT *, CASE WHEN day >= timeout THEN 'timeout' WHEN stopped AND (stop_first OR NOT took) THEN 'stop_loss' WHEN took THEN 'take_profit' ELSE action END AS cause FROM judged),
closing AS (SELECT *, CASE cause WHEN 'stop_loss' THEN fill_price * (1 + stop_loss * direction) - paid WHEN 'take_profit' THEN fill_price * (1 + take_profit * direction) - paid WHEN 'bankruptcy' THEN 0 ELSE close END AS price
  FROM caused WHERE cause IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY day) = 1),
exits AS (SELECT order_id, day AS close_date, price AS close_price, cause AS close_cause, (price / fill_price - 1) * direction AS ret, ((price + paid) / fill_price - 1) * direction AS total_ret, paid * abs(amount) AS total_dividends,
  CASE WHEN direction > 0 THEN abs(amount) * price ELSE (price / fill_price - 1) * direction * fill_price * abs(amount) END AS proceeds, ((price + paid) / fill_price - 1) * direction * fill_price AS pnl FROM closing)"""
PARTS["active"] = "active AS (SELECT p.* FROM paths p LEFT JOIN exits e USING (order_id) WHERE p.day <= coalesce(e.close_date, p.timeout))"

NEEDS = {
    "pit": ["bars", "filings"], "known": ["pit", "metadata"], "adj": ["known"], "rets": ["adj"], "priced": ["rets"], "monthly": ["adj"], "sampled": ["priced", "monthly"], "filled_days": ["bars"], "rates": ["bills"],
    "filled": ["filings"], "featured": ["filled", "metadata"], "industries": ["featured"], "actions": ["bars", "corp_events"], "scored": ["sampled"], "walked": ["known"], "numbered": ["scored"], "rebalanced": ["numbered", "filled_days", "actions"], "trades": ["bars"], "paths": ["trades"], "exits": ["paths", "actions"], "active": ["exits"],
}


def with_parts(*names: str) -> str:
    wanted: set[str] = set()

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        wanted.add(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if "walked" in wanted else "WITH ") + ",\n".join(PARTS[n] for n in PARTS if n in wanted) + "\n"


def r(x: str, digits: int = 6, name: str | None = None) -> str:
    """A rounded double without negative zero."""
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def trailing_sql() -> str:
    return _trailing()


size_sql = _size
