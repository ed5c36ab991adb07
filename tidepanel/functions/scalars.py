"""Scalar expressions; all stay inside the JVM."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(x) -> Column:
    """NaN and ±Inf both mean missing, and missing is NULL."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def positive_or_null(x) -> Column:
    x = finite_or_null(x)
    return F.when(x > 0, x)


def log_ratio(a, b) -> Column:
    """ln(a / b), NULL unless both sides are positive."""
    a, b = positive_or_null(a), positive_or_null(b)
    return F.log(a / b)


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep NULL as NULL (least/greatest alone would skip it)."""
    x = _col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def pct_change(current, previous) -> Column:
    """100 · (current / previous − 1) with a positive base."""
    previous = positive_or_null(previous)
    return F.lit(100.0) * (_col(current) / previous - F.lit(1.0))


def log_percent_to_percent(x) -> Column:
    return F.lit(100.0) * F.expm1(_col(x))


def real_value(nominal, price_index) -> Column:
    return _col(nominal) / positive_or_null(price_index)


def season_phase(month_of_year, prefix: str) -> dict[str, Column]:
    angle = F.lit(2 * math.pi / 12) * (_col(month_of_year) + 1)
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def abs_error(actual="actual", predicted="predicted") -> Column:
    return F.abs(_col(actual) - _col(predicted))


def signed_error(actual="actual", predicted="predicted") -> Column:
    return _col(predicted) - _col(actual)


def shock_factor(shape, shift, k, span: int = 6) -> Column:
    """Multiplier k periods after the change point; 1 outside the span."""
    shape, shift, k = _col(shape), _col(shift), _col(k)
    inside = (k >= 0) & (k < span)
    return (
        F.when(~inside, F.lit(1.0))
        .when(shape == "step", 1 + shift)
        .when(shape == "pulse", F.when(k == 0, 1 + shift).otherwise(F.lit(1.0)))
        .when(shape == "ramp", 1 + shift * k / F.lit(float(span - 1)))
    )


def base_model(name, suffix: str = "_seasonal") -> Column:
    """Name of the control a suffixed model is compared with."""
    return F.regexp_replace(_col(name), f"{suffix}$", "")


def parse_id_list(text) -> Column:
    return F.from_json(_col(text), "array<bigint>")


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def host_allowed(url, pattern: str) -> Column:
    """True when the whole host matches; a match elsewhere in the URL does not count."""
    return url_host(url).rlike(f"^(?:{pattern})$")


def id_uniform(seed, ident) -> Column:
    """Uniform [0, 1) number that depends on seed and id alone (first 48 bits of SHA-256)."""
    digest = F.sha2(F.concat(_col(seed).cast("string"), F.lit(":"), _col(ident).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def student_two_sided_p(stat, dof) -> Column:
    """Two-sided tail of Student's t for integer degrees of freedom by its finite sum.

    With θ = atan(|t|/√ν) the central probability is sinθ · Σ c_j cos^{2j}θ for even ν and
    2/π · (θ + sinθ · Σ d_j cos^{2j+1}θ) for odd ν.
    """
    stat, dof = F.abs(_col(stat)), _col(dof).cast("int")
    theta = F.atan(stat / F.sqrt(dof.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)

    def series(terms, numerator, denominator, start):
        # Running term and running sum; the j-th ratio is numerator(j) / denominator(j) · cos².
        zero = F.struct(start.alias("term"), start.alias("total"))
        steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            steps, zero,
            lambda acc, j: F.struct(
                (acc["term"] * numerator(j) / denominator(j) * cos2).alias("term"),
                (acc["total"] + acc["term"] * numerator(j) / denominator(j) * cos2).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    even = F.sin(theta) * series(
        F.floor(dof / 2).cast("int"), lambda j: 2.0 * j - 1, lambda j: 2.0 * j, F.lit(1.0)
    )
    odd_sum = series(
        F.floor((dof - 1) / 2).cast("int"), lambda j: 2.0 * j, lambda j: 2.0 * j + 1, F.cos(theta)
    )
    odd = F.lit(2 / math.pi) * (theta + F.when(dof > 1, F.sin(theta) * odd_sum).otherwise(F.lit(0.0)))
    return F.lit(1.0) - F.when(dof % 2 == 0, even).otherwise(odd)
