"""Domain tables derived from order and line-item tables.

Each is one statement that Spark and DuckDB both run, with {table} for every input, so results can be
checked against a second engine; prices are divided by 9.97 so that
few end in a half at the digits compared. Suppliers play the tickers, line items the trades of a day, orders the filings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.sources.readers import FILING_VALUES

BARS = """
SELECT CAST(l_suppkey AS STRING) AS ticker, CAST(l_shipdate AS DATE) AS date,
       min_by(l_extendedprice / (l_quantity * 9.97), l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT)) AS open,
       max(l_extendedprice / (l_quantity * 9.97)) AS high, min(l_extendedprice / (l_quantity * 9.97)) AS low,
       max_by(l_extendedprice / (l_quantity * 9.97), l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT)) AS close,
       sum(l_quantity) AS volume, sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) AS dividends
FROM {lineitem} WHERE l_quantity > 0 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""

#: each filing value as a formula of the filing's order sum s, largest m, count n and a small key h
_VALUES = {
    "assets": "2 * s + 1000 * h", "assetsavg": "2 * s + 500 * n", "assetsc": "s + 100 * h", "capex": "CASE WHEN h % 17 = 0 THEN NULL ELSE 0.1 * m + h END",
    "cashneq": "0.2 * s + h", "cashnequsd": "0.25 * s", "cor": "0.5 * m + 10 * h", "debtc": "0.1 * s * (h % 5)", "debtnc": "0.3 * s - 10 * h",
    "depamor": "0.05 * m + n", "ebit": "0.2 * m - 100 * (h % 7)", "equity": "0.8 * s + 7 * h", "equityusd": "0.8 * s + 9 * h",
    "intangibles": "0.05 * s", "intexp": "CASE WHEN h % 7 = 0 THEN 0 ELSE 0.01 * m + h END", "invcap": "1.2 * s + h",
    "inventory": "CASE WHEN h % 11 = 0 THEN NULL WHEN h % 13 = 0 THEN 0 ELSE 0.15 * s - h END", "investmentsc": "0.02 * s", "liabilities": "1.1 * s + 3 * h",
    "liabilitiesc": "0.4 * s + 5 * h", "marketcap": "3 * m + 1000 * h", "ncfo": "0.15 * m - 50 * (h % 9)", "netinc": "0.1 * m - 200 * (h % 10)",
    "opinc": "0.18 * m - h", "payables": "0.09 * s", "ppnenet": "0.6 * s - h", "receivables": "0.12 * s + n", "revenueusd": "m + 20 * h",
    "rnd": "CASE WHEN h % 4 = 0 THEN 0 ELSE 0.03 * m END", "sgna": "0.07 * m + n", "sharefactor": "1.0", "sharesbas": "1000.0 * (1 + h % 50)",
    "tangibles": "1.9 * s", "taxexp": "0.02 * m - (h % 3)",
}

FILINGS = f"""
SELECT ticker, calendardate, calendardate + CAST(20 + delay AS INT) AS datekey,
       {", ".join(f"CAST({_VALUES[c]} AS DOUBLE) AS {c}" for c in FILING_VALUES)}
FROM (SELECT CAST(slot AS STRING) AS ticker, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS calendardate, o_custkey % 60 AS delay,
             sum(o_totalprice) AS s, max(o_totalprice) AS m, count(*) AS n, sum(o_orderkey) % 97 AS h
      FROM (SELECT *, o_custkey % (SELECT count(*) FROM {{supplier}}) AS slot FROM {{orders}}) AS o GROUP BY 1, 2, 3) AS g
"""

#: filings by customer: most customers skip quarters, and some file one twice
CUSTOMER_FILINGS = """
SELECT CAST(o_custkey AS STRING) AS ticker, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS calendardate,
       last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) + CAST(20 + 30 * (o_orderkey % 2) AS INT) AS datekey, sum(o_totalprice) AS assets
FROM {orders} GROUP BY o_custkey, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)), o_orderkey % 2
"""

METADATA = """
SELECT CAST(s_suppkey AS STRING) AS ticker, CASE WHEN s_suppkey % 10 = 9 THEN 'OTHER' ELSE 'SF1' END AS source_table,
       CASE n_nationkey WHEN 3 THEN 'Tobacco' WHEN 11 THEN 'Gambling' ELSE n_name END AS industry, r_name AS sector, CAST(n_nationkey * 100 AS INT) AS siccode,
       CAST(f.first AS DATE) + CAST(900 * CAST(s_suppkey % 4 = 1 AS INT) AS INT) AS firstpricedate
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
JOIN (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS first FROM {lineitem} GROUP BY l_suppkey) AS f ON f.l_suppkey = s_suppkey
"""

#: per cent a year, with the days whose number in the month divides by five missing
BILLS = """
SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN day(l_shipdate) % 7 = 0 THEN NULL ELSE avg(l_tax) * 100 END AS percent
FROM {lineitem} WHERE day(l_shipdate) % 5 <> 0 GROUP BY CAST(l_shipdate AS DATE), day(l_shipdate)
"""

EVENTS = """
SELECT CAST(o_custkey % (SELECT count(*) FROM {supplier}) AS STRING) AS ticker, CAST(o_orderdate AS DATE) AS date,
       concat_ws('|', CAST(CASE WHEN o_orderkey % 300 = 7 THEN 13 ELSE 20 + o_orderkey % 5 END AS STRING), CAST(30 + o_orderkey % 90 AS STRING)) AS eventcodes
FROM {orders}
"""

STATEMENTS = {"bars": BARS, "filings": FILINGS, "customer_filings": CUSTOMER_FILINGS, "metadata": METADATA, "bills": BILLS, "corp_events": EVENTS}
INPUTS = ("lineitem", "orders", "supplier", "nation", "region")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of bars, filings, customer_filings, metadata, bills, corp_events over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in INPUTS if f"{{{t}}}" in STATEMENTS[name]}
    return spark.sql(STATEMENTS[name], **used)


def duckdb_with(*names: str, more: str = "") -> str:
    """A WITH clause that defines domain tables for DuckDB."""
    parts = [f"{n} AS ({STATEMENTS[n].format(**{t: t for t in INPUTS}).strip()})" for n in names]
    return "WITH " + ",\n".join([*parts, *([more] if more else [])]) + "\n"
