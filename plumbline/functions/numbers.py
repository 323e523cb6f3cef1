"""Column functions over scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, inverted: bool = False) -> Column:
    value = 1 - value if inverted else value
    return F.when(value >= 0.75, "high").when(value >= 0.40, "medium").otherwise("low")


def cross_encoder_band(logit: Column) -> Column:
    return F.when(logit >= 3.0, "relevant").when(logit >= 0.0, "partial").otherwise("irrelevant")


def tempered(p: Column, temperature: float) -> Column:
    """sigmoid(logit(p) / T); 0 and 1 stay."""
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(1 / (1 + F.exp(-F.ln(p / (1 - p)) / F.lit(temperature))))


def bucket(p: Column) -> Column:
    return F.when(p >= 0.9, "very_high").when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def numeric_token(text: Column) -> Column:
    """The first number of a text, without commas, times its k, m or b."""
    parts = lambda i: F.regexp_extract(text, r"(\d[\d,]*(?:\.\d+)?)(?:\s?([kKmMbB])\b)?", i)
    times = F.lower(parts(2))
    return F.regexp_replace(parts(1), ",", "").try_cast("double") * F.when(times == "k", 1e3).when(times == "m", 1e6).when(times == "b", 1e9).otherwise(1.0)
