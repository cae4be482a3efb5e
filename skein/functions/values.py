"""Numbers, vectors, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change(first: Column, last: Column, unit: Column) -> Column:
    """Basis points for rates, percent for others; null without two values or from zero."""
    return F.when(unit == "basis_points", (last - first) * 100).otherwise(F.when(first != 0, (last / first - 1) * 100))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector counts as norm 1."""
    size = lambda v: F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (size(a) * size(b))


def bounded(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def valid_distribution(p: Column, choice: Column, slack: float = 0.005) -> Column:
    """Map of finite probabilities that sum to 1, within `slack` a value, with `choice` as its largest."""
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    fair = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(fair & (F.size(p) > 0) & (F.abs(total - 1) <= F.size(p) * slack) & (p[choice] == F.array_max(values)), F.lit(False))


def ordered_unique(values: Column) -> Column:
    """Distinct trimmed values without blanks, first come first."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def json_body(reply: Column) -> Column:
    """From the first brace to the last, fences and chatter around it dropped; null if none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def digit_ids(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"\D", "").try_cast("bigint")), lambda v: v.isNotNull())


def importance(raw: Column) -> Column:
    """1, 2 or 3; anything else is 0."""
    n = F.trim(raw.cast("string"))
    return F.when(n.isin("1", "2", "3"), n.cast("int")).otherwise(0)


def truthy(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin("true", "yes", "1", "keep"), F.lit(False))
