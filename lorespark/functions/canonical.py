"""Canonical JSON of maps, and Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_map(values: Column) -> Column:
    """JSON of a map of strings with sorted keys and no blanks; a missing value is null. Stays in the JVM."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entries = F.transform(F.array_sort(F.map_keys(values)), lambda k: F.concat(text(k), F.lit(":"), F.coalesce(F.when(values[k].isNotNull(), text(values[k])), F.lit("null"))))
    return F.when(values.isNotNull(), F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark lacks; in Arrow batches."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")
