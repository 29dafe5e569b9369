import numpy as np
import pandas as pd


def hours(start, n):
    return pd.date_range(start, periods=n, freq="h")


def demand(n=300, start="2023-01-01", series=("a",), seed=0, temperature=True):
    rng = np.random.default_rng(seed)
    parts = []
    for s in series:
        pdf = pd.DataFrame({"series_id": s, "ts": hours(start, n), "demand_gw": rng.uniform(60, 150, n)})
        if temperature:
            pdf["temperature_f"] = rng.uniform(20, 100, n)
        parts.append(pdf)
    return pd.concat(parts, ignore_index=True)


def sparse(n=400, keep=0.4, series=("a", "b"), seed=1):
    pdf = demand(n, series=series, seed=seed, temperature=False)
    rng = np.random.default_rng(seed)
    return pdf[rng.uniform(size=len(pdf)) < keep].reset_index(drop=True)


def collect(df, by=("series_id", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
