"""Frames that several test modules make."""

import pandas as pd


def long(frame: pd.DataFrame, value: str = "r") -> pd.DataFrame:
    """Wide dates-by-tickers frame to long rows, missing cells left out."""
    out = frame.rename_axis(index="date", columns="ticker").stack().rename(value).reset_index()
    out["date"] = pd.to_datetime(out["date"]).dt.date
    return out.dropna(subset=[value])
