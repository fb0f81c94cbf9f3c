"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jestframe.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: its
    lineage ends there, and a lost executor costs no recomputation above it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def sampled(key: Column, fraction: float, seed: int = 17) -> Column:
    """True for a keyed ``fraction`` of the keys, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) < int(min(1.0, fraction) * 1_000_003)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(keep: list[str], own: list[str]) -> list[str]:
    """The columns to keep whose names are none of the operator's ``own`` results,
    which take their place."""
    taken = {c.lower() for c in own}
    return [c for c in keep if c.lower() not in taken]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often it is used,
    inside lambdas too (the optimizer would put an expression into each place)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
