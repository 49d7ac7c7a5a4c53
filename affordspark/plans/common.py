"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND = 4  # decimals kept on every double a query returns (oracle hygiene)
# Values that sit exactly on a half (e.g. 65184.51 / 8 = 8148.06375) come out
# one ulp apart in different engines; a nudge far below the kept precision and
# far above ulp noise makes every engine break such ties the same way.
NUDGE = 1e-7


def rounded(c, decimals: int = ROUND):
    return F.round(c.cast("double") + F.lit(NUDGE), decimals)


def round_doubles(df: DataFrame, decimals: int = ROUND) -> DataFrame:
    """Round every double/float column; float sums taken in a different order
    differ in the last bits, so results are compared at this precision."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(rounded(F.col(f.name), decimals).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
