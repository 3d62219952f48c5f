"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Equi-join where few keys of `right` meet very many rows of `left`.

    Left rows of one key go to `SALTS` partitions by a hash of `spread`; every right row is
    repeated once per salt. The result is the plain join. No broadcast is forced: adaptive
    execution still picks one when the right side turns out small.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
