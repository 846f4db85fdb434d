"""Scalar Column helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the inverse
# standard normal CDF (published constants; relative error < 1.2e-9).
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
ACKLAM_LOW = 0.02425


def _horner(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF of ``p`` in (0, 1) (NULL outside)."""
    low, high = ACKLAM_LOW, 1 - ACKLAM_LOW
    q_low = F.sqrt(-2 * F.log(p))
    tail_low = _horner(ACKLAM_C, q_low) / (_horner(ACKLAM_D, q_low) * q_low + F.lit(1.0))
    q_high = F.sqrt(-2 * F.log(1 - p))
    tail_high = -_horner(ACKLAM_C, q_high) / (_horner(ACKLAM_D, q_high) * q_high + F.lit(1.0))
    q = p - 0.5
    r = q * q
    central = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + F.lit(1.0))
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
            .when(p < low, tail_low).when(p > high, tail_high).otherwise(central))


def norm_ppf_sql(p: str) -> str:
    """The same formula as SQL text (for the DuckDB oracle)."""
    def horner(coefs, x):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"(({acc}) * {x} + {c!r})"
        return acc
    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 OR {p} IS NULL THEN NULL "
            f"WHEN {p} < {ACKLAM_LOW} THEN {horner(ACKLAM_C, ql)} / ({horner(ACKLAM_D, ql)} * {ql} + 1.0) "
            f"WHEN {p} > {1 - ACKLAM_LOW} THEN -{horner(ACKLAM_C, qh)} / ({horner(ACKLAM_D, qh)} * {qh} + 1.0) "
            f"ELSE {horner(ACKLAM_A, r)} * {q} / ({horner(ACKLAM_B, r)} * {r} + 1.0) END")


def pick_not_none(*cols: Column) -> Column:
    """First non-null argument."""
    return F.coalesce(*cols)


def percent_text(x: Column, digits: int = 1) -> Column:
    """'12.3%' from a fraction (NULL / 0 -> 'N/A')."""
    return F.when(x.isNull() | (x == 0), F.lit("N/A")).otherwise(
        F.format_string(f"%.{digits}f%%", F.round(x * 100, digits)))


def fixed_text(x: Column, digits: int = 3) -> Column:
    """'0.123' (no grouping separators)."""
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.format_string(f"%.{digits}f", x))


def truncate_id(s: Column, head: int = 15, tail: int = 10) -> Column:
    """Long ids shown as head + '...' + tail."""
    short = F.concat(F.substring(s, 1, head), F.lit("..."), F.substring(s, -tail, tail))
    return F.when(F.length(s) > head + tail + 3, short).otherwise(s)


def null_text(x: Column, marker: str = "NULL") -> Column:
    """Preview text of any value, NULL shown as a marker."""
    return F.coalesce(x.cast("string"), F.lit(marker))


def whole_days_between(a: Column, b: Column) -> Column:
    return F.floor((F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 86400)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def inverse_quality(x: Column) -> Column:
    """1 / (1 + x): turns a lower-is-better score into a 0-1 quality."""
    return F.lit(1.0) / (F.lit(1.0) + x)


def sig_round(x: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (comparable across summation orders)."""
    p = F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(x))) - digits)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x == 0, F.lit(0.0)).otherwise(F.round(x / p) * p)


def sig_round_sql(x: str, digits: int = 9) -> str:
    p = f"pow(10.0, ceil(log10(abs({x}))) - {digits})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 THEN 0.0 ELSE round(({x}) / {p}) * {p} END)"


def rnd(x, digits: int = 0) -> Column:
    """Round the double VALUE half away from zero: round(x * 10^d) / 10^d.

    Spark's ``round`` on a double rounds its shortest decimal text (0.5035 ->
    0.504), whereas the binary value is 0.50349999999999995 (C ``round``,
    DuckDB and Python give 0.503). Scaling first makes Spark round the binary
    value too, so results are identical across engines.
    """
    c = F.col(x) if isinstance(x, str) else x
    m = F.lit(float(10 ** digits))
    return F.round(c * m, 0) / m


def quoted(name: str | Column) -> Column:
    """The column called ``name``, whatever characters (dots too) the name holds."""
    return name if isinstance(name, Column) else F.col("`" + name.replace("`", "``") + "`")


def named(names) -> list[Column]:
    """Columns by name; what are columns already stay so."""
    return [quoted(n) for n in names]
