"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import QueryError


def lines(result: DataFrame) -> DataFrame:
    """One ``line`` per result row, in the order of the result."""
    if "phi" not in result.columns:
        return result.select(F.col("metric").alias("line"))
    # positional notation: a double's own text switches to an exponent below a thousandth
    plain = F.rtrim(F.col("phi").cast("string").cast("decimal(38,36)").cast("string"), F.lit("0"))
    phi = F.when(F.col("phi") >= 0.001, F.col("phi").cast("string")).otherwise(plain)
    fields = ["start=", "window_start", ", end=", "window_end", ", phi=", phi, ", count=", "count", ", approx=", "approx", ", lower=", "lower", ", upper=", "upper"]
    return result.select(F.concat(*[F.lit(f) if k % 2 == 0 else (f if not isinstance(f, str) else F.col(f).cast("string")) for k, f in enumerate(fields)]).alias("line"))


def error_line(error: QueryError) -> str:
    """The reply to a query that cannot be planned."""
    return f"[ERROR] {type(error).__name__}({error})"
