"""Ordered cut lists turned into CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonegauge.config import RiskProfile

Cut = tuple[float, str]


def bucket(
    c: Column,
    default: str,
    above: Sequence[Cut] = (),
    below: Sequence[Cut] = (),
    inclusive: bool = False,
) -> Column:
    """First matching cut wins; NULL falls through to `default`."""
    expr = None
    for cut, label in above:
        hit = c >= F.lit(cut) if inclusive else c > F.lit(cut)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    for cut, label in below:
        hit = c <= F.lit(cut) if inclusive else c < F.lit(cut)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def risk_tier(score: Column, profile: RiskProfile) -> Column:
    cuts = [(profile.high_cut, "HIGH"), (profile.medium_cut, "MEDIUM")]
    return bucket(score, "LOW", above=cuts, inclusive=profile.cuts_inclusive)


# Cuts and words of the report buckets.
def sentiment_word(score: Column) -> Column:
    return bucket(score, "neutral", above=[(0.05, "positive")], below=[(-0.05, "negative")])


def sentiment_direction(score: Column) -> Column:
    return bucket(score, "Neutral", above=[(0.05, "Positive")], below=[(-0.05, "Negative")])


def trend_word(change: Column) -> Column:
    return bucket(change, "Stable", above=[(0.02, "Rising")], below=[(-0.02, "Falling")])


def negative_share_colour(share: Column) -> Column:
    return bucket(share, "green", above=[(0.4, "red"), (0.25, "amber")])


def score_colour(score: Column) -> Column:
    return bucket(score, "green", above=[(40.0, "red"), (20.0, "amber")])


def anomaly_colour(days: Column) -> Column:
    return bucket(days, "cyan", above=[(20, "red"), (10, "amber")])


def anomaly_amount(days: Column) -> Column:
    return bucket(days, "a few", above=[(20, "a critical number of"), (10, "several")])


TIER_COLOURS = {"HIGH": "#ef4444", "MEDIUM": "#f59e0b", "LOW": "#22c55e"}
UNKNOWN_TIER_COLOUR = "#475569"


def tier_colour(tier: Column) -> Column:
    """Colour of a tier by literal map lookup."""
    table = F.create_map(*[F.lit(x) for pair in TIER_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tier), F.lit(UNKNOWN_TIER_COLOUR))
