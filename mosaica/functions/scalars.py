"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The polynomial approximation 7.1.26 of the error function in Abramowitz and Stegun, absolute error 1.5e-7.
ERF_P = 0.3275911
#: Far below the digits kept, far above rounding errors.
NUDGE = 1e-10
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with one kind of zero and NaN as null; a nudge keeps halves that are exact in theory from falling either way."""
    c = col(c)
    return F.when(~F.isnan(c), F.round(c + NUDGE, digits) + F.lit(0.0))


def normal_two_sided(z: str | Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z, by the polynomial above."""
    x = F.abs(col(z)) / F.lit(math.sqrt(2))
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in ERF_A[3::-1]:
        poly = poly * t + F.lit(a)
    return poly * t * F.exp(-x * x)


def normal_two_sided_sql(z: str) -> str:
    """The same in SQL text."""
    x = f"(abs({z})/{math.sqrt(2)!r})"
    t = f"(1e0/(1e0+{ERF_P!r}*{x}))"
    poly = f"{ERF_A[4]!r}"
    for a in ERF_A[3::-1]:
        poly = f"({poly}*{t}+({a!r}))"
    return f"({poly}*{t}*exp(-{x}*{x}))"


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: closed forms by recurrence on the degrees of freedom."""
    if df < 1 or not math.isfinite(x):
        return math.nan
    if x <= 0:
        return 1.0
    if df % 2:
        out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(1, (df - 1) // 2 + 1):
            out += term
            term *= x / (2 * k + 1)
        return out
    term = out = math.exp(-x / 2)
    for k in range(1, df // 2):
        term *= x / (2 * k)
        out += term
    return out


def log_distance(d: str | Column, low: float, high: float) -> Column:
    """The logarithm of a distance, scaled to [0, 1] between the bounds and clipped there."""
    return F.least(F.greatest((F.ln(F.greatest(col(d), F.lit(1e-12))) - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by)))


def safe_name(c: str | Column) -> Column:
    """Anything but letters, digits, point, underscore and hyphen as an underscore."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}._-]", "_")


def niche_name(c: str | Column) -> Column:
    return F.when(col(c) == 0, F.lit("Background")).otherwise(F.concat(F.lit("Niche "), col(c).cast("string")))


def hash_uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) that the parts determine, the same in every engine with md5."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays of numbers, in double precision and array order."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: str | Column) -> Column:
    """An array scaled to unit length; a zero array stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def softmax_over(score: str, *keys: str) -> Column:
    """Softmax of a score within groups, the largest subtracted first."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def argmax_array(v: str | Column) -> Column:
    """Place of the largest item, from 0; of equals the first."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def input_kind(path: str | Column, declared: str | Column | None = None) -> Column:
    """csv, tsv, h5ad or sce: what is declared (rds means sce), or else what the suffix says; unknown ones are an error."""
    names = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "h5ad": "h5ad", "sce": "sce", "rds": "sce"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    suffix = F.regexp_extract(F.lower(col(path)), r"\.([^./]+)$", 1)
    said = F.lower(F.trim(col(declared))) if declared is not None else F.lit(None).cast("string")
    key = F.coalesce(F.when(said != "", said), suffix)
    return F.coalesce(F.element_at(table, key), F.raise_error(F.concat(F.lit("unknown input type: "), key)))
