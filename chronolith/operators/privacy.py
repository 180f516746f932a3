"""Privacy projection: payload keys that are not listed go, listed ones can become keyed tokens."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.schema import payload


def token(field: str, value: Column, key: bytes) -> Column:
    """``hmac-sha256:<hex>`` of the field's name and the text; null stays null."""
    if len(key) < 32:
        raise ValueError("the key needs 32 bytes at least")
    head = f"{field.lower()}\0text\0".encode()

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        for t in texts.dropna().unique():
            known[t] = "hmac-sha256:" + hmac.new(key, head + t.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()
        return pd.Series([known.get(t) for t in texts], index=texts.index, dtype=object)

    return made(value.cast("string"))


def project(rows: DataFrame, keep: Sequence[str], tokens: Sequence[str] = (), key: bytes = b"") -> DataFrame:
    """``rows`` whose payload has only the ``keep`` keys as they are and the ``tokens`` keys as tokens."""
    lower = [k.lower() for k in keep]
    kept = F.map_filter("values", lambda k, _: F.lower(k).isin(lower))
    if tokens:
        pairs = [F.struct(F.lit(t).alias("key"), token(t, payload(t), key).alias("value")) for t in tokens]
        kept = F.map_concat(kept, F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())))
    return rows.withColumn("values", kept)
