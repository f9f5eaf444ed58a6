"""Bit patterns of doubles, vectorised over Arrow batches."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def double_bits(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy(dtype="float64", copy=True).view("int64"))


@F.pandas_udf(T.DoubleType())
def bits_double(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(dtype="int64", copy=True).view("float64"))
