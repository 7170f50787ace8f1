"""Token buckets, one for each key, over requests in order of time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _bucket(rate: float, burst: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "id"]).reset_index(drop=True)
        tokens, last, waits = burst, None, []
        for at in rows["at"]:
            now = at if last is None else max(at, last)
            if last is not None:
                tokens = min(burst, tokens + (now - last) * rate)
            wait = (now - at) + (max(0.0, (1 - tokens) / rate) if tokens < 1 else 0.0)
            last = at + wait
            tokens = min(burst, tokens + (last - now) * rate) - 1
            waits.append(round(wait, 6))
        return rows.assign(wait=waits)

    return run


def token_bucket(requests: DataFrame, rate: float = 2.0, burst: float = 5.0) -> DataFrame:
    """(id, key, at, wait) of (id, key, at in seconds): how long each request waits for its token."""
    return requests.select("id", "key", "at").groupBy("key").applyInPandas(_bucket(rate, burst), "id long, key string, at double, wait double")
