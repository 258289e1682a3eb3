"""Request validation re-aimed as batch quarantine.

Instead of rejecting one request, a batch is split: every row gets an
``errors`` array (empty when valid); callers keep ``is_valid`` rows and
write the rest to a quarantine table.  Pure column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed messages (one per rule).
MSG_QUANTITY = "quantity must be > 0"
MSG_PRICE = "price must be > 0"
MSG_DISCOUNT = "discount_pct must be >= 0"
MSG_PROMOTION = "promotion_flag must be 0 or 1"


def transaction_errors(quantity="quantity", price="price", discount="discount_pct",
                       promotion="promotion_flag"):
    """Rule violations of a transaction row as an array of messages."""
    q, p = F.col(quantity).try_cast("double"), F.col(price).try_cast("double")
    d = F.coalesce(F.col(discount).try_cast("double"), F.lit(0.0))
    pr = F.coalesce(F.col(promotion).try_cast("double"), F.lit(0.0))
    checks = F.array(
        F.when(q.isNull() | (q <= 0), F.lit(MSG_QUANTITY)),
        F.when(p.isNull() | (p <= 0), F.lit(MSG_PRICE)),
        F.when(d < 0, F.lit(MSG_DISCOUNT)),
        F.when(~pr.isin(0.0, 1.0), F.lit(MSG_PROMOTION)),
    )
    return F.filter(checks, lambda x: x.isNotNull())


def missing_argument_errors(df: DataFrame, required: list[str]):
    """A required argument that is absent, null or "" is an error."""
    checks = []
    for c in required:
        if c not in df.columns:
            checks.append(F.lit(f"missing required argument: {c}"))
        else:
            v = F.col(c)
            checks.append(F.when(v.isNull() | (v.cast("string") == ""),
                                 F.lit(f"missing required argument: {c}")))
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def quarantine(df: DataFrame, required: list[str] | None = None,
               transaction_rules: bool = True) -> DataFrame:
    """Add ``errors`` (array<string>) and ``is_valid`` columns."""
    parts = []
    if required:
        parts.append(missing_argument_errors(df, required))
    if transaction_rules:
        parts.append(transaction_errors())
    errs = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def split_valid(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    q = quarantine(df, **kw)
    return q.filter("is_valid").drop("errors", "is_valid"), q.filter(~F.col("is_valid"))
