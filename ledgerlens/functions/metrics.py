"""Tone metrics from counts. A zero denominator gives 0.0."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ratio, rounded

#: Categories of content richness: litigious and complex words are none of it.
RICH = ("Positive", "Negative", "Uncertainty", "Strong", "Weak", "Constraining")


def tone_ratios(n: Mapping[str, Column], total: Column, distinct: Column, letters: Column, esg: Column, rounding: str = "spark") -> dict[str, Column]:
    """n: counts by category; total, distinct: tokens; letters: the sum of their lengths."""
    pos, neg = n["Positive"], n["Negative"]
    rich = sum((n[c] for c in RICH[1:]), n[RICH[0]])
    r = lambda c, d: rounded(c, d, rounding)
    return {
        "type_token_ratio": r(ratio(distinct, total), 4),
        "avg_word_length": r(ratio(letters, total), 4),
        "net_tone": r(ratio(pos - neg, total), 6),
        "sentiment_score": r((pos - neg) / (pos + neg + 1), 6),
        "polarity_ratio": r(ratio(pos, pos + neg), 4),
        "esg_count": esg,
        "esg_density": r(ratio(esg, total) * 1000, 4),
        "uncertainty_ratio": r(ratio(n["Uncertainty"], total), 6),
        "litigiousness_ratio": r(ratio(n["Litigious"], total), 6),
        "constraining_ratio": r(ratio(n["Constraining"], total), 6),
        "modal_strength_ratio": r(ratio(n["Strong"] - n["Weak"], total), 6),
        "complexity_ratio": r(ratio(n["Complexity"], total), 6),
        "content_richness": r(ratio(rich, total), 6),
    }


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0.0 for all where all are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """0.0 for all where all are equal."""
    return F.when(std == 0, F.lit(0.0)).otherwise((x - mean) / F.nullif(std, F.lit(0.0)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
