"""Scores and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEAD_BAND, EPSILON = 0.01, 1e-10
# Weights of the impact score, tokens that one developer writes in a month.
WEIGHTS = (0.25, 0.25, 0.5)
TOKENS_PER_MONTH, DAYS = 1_000_000, 30


def safe(x: Column) -> Column:
    """SF-10: null, NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """SF-11: without spread 0 at the mean and 1 with its sign elsewhere."""
    return F.when(sd < EPSILON, F.when(F.abs(x - mean) < EPSILON, 0.0).otherwise(F.signum(x - mean))).otherwise((x - mean) / sd)


def impact(z_complexity: Column, z_effort: Column, z_mi: Column) -> Column:
    """SF-12: less complexity and effort and more maintainability are better."""
    a, b, c = WEIGHTS
    return a * -z_complexity + b * -z_effort + c * z_mi


def impact_percent(z_complexity: Column, z_effort: Column, z_mi: Column) -> Column:
    """A hundred times ``impact``, in whole numbers if the arguments are."""
    a, b, c = (round(100 * w) for w in WEIGHTS)
    return a * -z_complexity + b * -z_effort + c * z_mi


def impact_category(score: Column) -> Column:
    return F.when(score > 1.0, "significant_improvement").when(score > 0.5, "minor_improvement").when(score >= -0.5, "neutral").when(score >= -1.0, "minor_degradation").otherwise("significant_degradation")


def z_label(z: Column, lower_is_better: bool, far: float = 1.0, near: float = 0.3) -> Column:
    """SF-13: how a z-score reads, with its direction."""
    good = -z if lower_is_better else z
    return F.when(good > far, "much better").when(good > near, "better").when(good >= -near, "about average").when(good >= -far, "worse").otherwise("much worse")


def advantage(base: Column, candidate: Column) -> Column:
    """SF-15: bounded relative gain."""
    gain = candidate - base
    return F.tanh(F.when(base > 0, F.try_divide(gain, base)).otherwise(gain))


def winner(a: Column, b: Column, name_a: str = "A", name_b: str = "B") -> Column:
    """SF-16."""
    return F.when(F.abs(b - a) < DEAD_BAND, "tie").when(b > a, name_b).otherwise(name_a)


def completion(current: Column, target: Column, higher_is_better: bool = False) -> Column:
    """SF-17: how far a value has come to its target; beyond it the overshoot is punished twice, unless more is better."""
    r = current / F.greatest(target, F.lit(1.0))
    return F.least(r, F.lit(1.0)) if higher_is_better else F.when(r <= 1, r).otherwise(1 - 2 * (r - 1))


def galen_rate(tokens: Column, days: Column) -> Column:
    """SF-18: tokens a day in units of one developer's; 0 without days."""
    return F.when(days > 0, F.abs(tokens) / days / (TOKENS_PER_MONTH / DAYS)).otherwise(0.0)


def human_count(n: Column) -> Column:
    """SF-20: ~1.5M, ~150K."""
    return F.when(n >= 1_000_000, F.concat(F.lit("~"), F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.lit("~"), F.format_string("%.0f", F.floor(n / 1e3).cast("double")), F.lit("K"))).otherwise(n.cast("string"))


def ladder(x: Column, green: float, yellow: float, lower_is_better: bool = False) -> Column:
    """SF-21: green, yellow or red by thresholds."""
    hit = (lambda t: x <= t) if lower_is_better else (lambda t: x >= t)
    return F.when(hit(green), "green").when(hit(yellow), "yellow").otherwise("red")


def trend_arrow(slope: Column, lower_is_better: bool) -> Column:
    """SF-22."""
    good = slope < 0 if lower_is_better else slope > 0
    return F.when(F.abs(slope) < DEAD_BAND, "flat").otherwise(F.concat(F.when(slope > 0, "up").otherwise("down"), F.lit(" "), F.when(good, "good").otherwise("bad")))


def truncate_path(path: Column, width: int) -> Column:
    """SF-23: the path with its middle left out, the file name kept where it fits."""
    name = F.element_at(F.split(path, "/"), -1)
    room = F.greatest(F.lit(width - 4) - F.length(name), F.lit(0))
    return F.when(F.length(path) <= width, path).when(F.length(name) + 4 > width, F.concat(F.lit("..."), F.right(name, F.lit(width - 3)))).otherwise(F.concat(F.left(path, room), F.lit(".../"), name))


def slug(name: Column) -> Column:
    """SF-31."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[_ ]", "-"), "[^a-z0-9-]", "")


def month_projection(tokens_per_day: Column, day: Column) -> Column:
    """SF-19: whether a month's goal is met, can still be met in what is left of it, or not."""
    left = F.lit(DAYS) - day
    needed = F.lit(TOKENS_PER_MONTH) - tokens_per_day * day
    return F.when(tokens_per_day * DAYS >= TOKENS_PER_MONTH, "on track").when((left <= 0) | (needed > tokens_per_day * left), "out of reach").otherwise("behind")


def baseline_cell(z: Column, invert: bool) -> Column:
    """SF-24: how far a value is from its baseline, in the direction that is good."""
    good = -z if invert else z
    return F.when(good > 1.0, "far above").when(good > 0.5, "above").when(good >= -0.5, "around").when(good >= -1.0, "below").otherwise("far below")


def status_mark(status: Column) -> Column:
    """SF-29: one sign for the status of a todo."""
    return F.when(status == "completed", "+").when(status == "in_progress", ">").when(status == "pending", ".").otherwise("?")
