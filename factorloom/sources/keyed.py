"""Tables for look-ups by key: row groups that a reader can rule out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a row group, distinct keys that a row group's Bloom filter is made for, and keys that one scan is asked for
GROUP_BYTES, GROUP_KEYS, SCAN_KEYS = 8 << 20, 1 << 17, 500


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], group_bytes: int = GROUP_BYTES, group_keys: int = GROUP_KEYS, partitions: int | None = None) -> None:
    """Write a table for look-ups by any of ``keys``.

    Rows are sorted by the first key over the whole table, so its value is in one or few row groups and their ends rule the others out;
    for all keys each row group has a Bloom filter, which rules it out for the others. Replaces what is there.
    """
    sets = {"parquet.block.size": group_bytes, "parquet.bloom.filter.max.bytes": 8 * group_keys}
    for k in keys:
        sets |= {f"parquet.bloom.filter.enabled#{k}": "true", f"parquet.bloom.filter.expected.ndv#{k}": group_keys}
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").options(**{k: str(v) for k, v in sets.items()}).parquet(path)


def among(key: str, values: Sequence[Any]) -> Column:
    """One equality a value, as Bloom filters are asked for equalities."""
    test = F.lit(False)
    for v in dict.fromkeys(values):
        test = test | (F.col(key) == F.lit(v))
    return test


def look_up(spark: SparkSession, path: str, key: str, values: Sequence[Any]) -> DataFrame:
    """The rows whose ``key`` is one of the values; null is none. Only row groups that may hold one are read.

    Meant for a page of values; the values of a table are joined with ``look_up_all``.
    """
    wanted = [v for v in dict.fromkeys(values) if v is not None]
    df = spark.read.parquet(path)
    if len(wanted) > SCAN_KEYS:
        raise ValueError(f"over {SCAN_KEYS} values: use look_up_all")
    return df.where(among(key, wanted)) if wanted else df.limit(0)


def look_up_all(spark: SparkSession, path: str, key: str, values: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in a column of that name of another table: a semi join, so each row comes once.

    The values' least and greatest are asked for first: one row, by which row groups are ruled out before the join.
    """
    low, high = values.agg(F.min(key), F.max(key)).first()
    df = spark.read.parquet(path)
    return df.where(F.col(key).between(F.lit(low), F.lit(high))).join(values.select(key), key, "left_semi") if low is not None else df.limit(0)
