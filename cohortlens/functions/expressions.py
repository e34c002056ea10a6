"""Column expressions shared by the operators.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
none is a Python UDF.  Every division goes through ``try_divide`` so ANSI
mode never raises on a zero denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk tier codes and their display labels.
RISK_SAFE, RISK_WATCH, RISK_HIGH, RISK_CRITICAL = 0, 1, 2, 3
RISK_LABELS = {0: "Safe", 1: "Watch", 2: "High Risk", 3: "Critical"}

# Thresholds of the rule-based risk tiers.
CRITICAL_SCORE = 40.0
CRITICAL_SUBMISSION = 0.25
CRITICAL_CLICKS = 10
WATCH_SCORE = 60.0
WATCH_SUBMISSION = 0.6
WATCH_DAYS_LATE = -7


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double; null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def week_index(day: Column) -> Column:
    """Week of a day offset; floor toward minus infinity (day -1 is week -1)."""
    return F.floor(day / F.lit(7))


def outcome_label(final_result: Column) -> Column:
    """1 = did not complete: anything but Pass/Distinction, null included."""
    return F.when(final_result.isin("Pass", "Distinction"), F.lit(0)).otherwise(F.lit(1))


def imd_band_code(imd_band: Column) -> Column:
    """First number of the band divided by ten, truncated; null if none.

    ``try_cast`` turns the empty match into null rather than failing under
    ANSI mode; the feature table then zero-fills it.
    """
    first_number = F.regexp_extract(imd_band, r"(\d+)", 1).try_cast("int")
    return (first_number / F.lit(10)).cast("int")


def disability_code(disability: Column) -> Column:
    return F.when(disability == "Y", F.lit(1)).otherwise(F.lit(0))


def risk_tier(
    score: Column,
    clicks: Column,
    submission_rate: Column,
    avg_days_early: Column,
    withdrew_early: Column,
    label: Column,
) -> Column:
    """Rule-based tier 0..3 computed from (zero-filled) features and the label."""
    critical_signals = (
        (score < CRITICAL_SCORE) | (submission_rate < CRITICAL_SUBMISSION) | (clicks < CRITICAL_CLICKS)
    )
    watch_signals = (score < WATCH_SCORE) | (submission_rate < WATCH_SUBMISSION) | (avg_days_early < WATCH_DAYS_LATE)
    return (
        F.when(withdrew_early == 1, F.lit(RISK_CRITICAL))
        .when((label == 1) & critical_signals, F.lit(RISK_CRITICAL))
        .when(label == 1, F.lit(RISK_HIGH))
        .when(watch_signals, F.lit(RISK_WATCH))
        .otherwise(F.lit(RISK_SAFE))
    )


def risk_label(risk: Column) -> Column:
    """Display label of a tier; ``Unknown`` for anything else."""
    expr = None
    for code, text in RISK_LABELS.items():
        expr = (F.when if expr is None else expr.when)(risk == code, F.lit(text))
    return expr.otherwise(F.lit("Unknown"))


def clamp_tier(risk: Column) -> Column:
    """Tier as int clamped to 0..3; unparsable, NaN or null counts as 0.

    Numbers and numeric text both go through one ``try_cast`` to double (no
    text round trip for an int column); the clamp happens before the
    truncating cast, so a huge value gives 3 instead of an overflow error.
    """
    value = risk.try_cast("double")
    # least/greatest skip nulls, so unparsable values are handled first.
    usable = value.isNotNull() & ~F.isnan(value)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(3.0), value)).cast("int")
    return F.when(usable, clamped).otherwise(F.lit(0))


def valid_number(value: Column) -> Column:
    """Present, a number, not NaN and not negative (feature statistics filter)."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text like Python's ``f"{v:.{digits}f}"`` (no separators).

    ``format_number`` with a pattern rounds the exact binary value half-to-even,
    the same rule as Python and C ``printf``.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def float_text(value: Column) -> Column:
    """A double as Python writes it: plain digits from 0.0001 up to 1e16, else ``1.5e-05``."""
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    plain = F.regexp_replace(F.rtrim(text.try_cast("decimal(38,18)").cast("string"), F.lit("0")), r"\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exponent = F.when(F.abs(power) >= 100, F.concat(F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(exponent)
    named = F.when(F.isnan(value.cast("double")), "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    with_power = F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.concat(mantissa, F.lit("e"), exponent))
    return F.coalesce(named, F.when(text.contains("E"), with_power).otherwise(text))


def grouped(value: Column, digits: int = 0) -> Column:
    """Text with thousands separators like Python's ``f"{v:,.{digits}f}"``."""
    return F.format_number(value.cast("double"), digits)
