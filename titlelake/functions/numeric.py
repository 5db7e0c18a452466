"""Numeric coercions and engagement rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(x, default: float | None = None) -> Column:
    """Text or number -> DOUBLE; unparsable -> null (or ``default``)."""
    v = _c(x).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def to_view_int(x) -> Column:
    """int(float(x)) truncated toward zero; unparsable, NaN, infinite or
    beyond BIGINT range -> 0."""
    d = to_number(x)
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.coalesce(F.when(finite, d.try_cast("bigint")), F.lit(0).cast("bigint"))


def to_ts(x) -> Column:
    """Text -> TIMESTAMP, unparsable -> null."""
    return F.try_to_timestamp(_c(x).cast("string"))


def rate(num, views) -> Column:
    """Per-view rate; views <= 0 or null, or a null numerator -> 0.0."""
    v = _c(views).cast("double")
    return F.coalesce(F.when(v > 0, _c(num).cast("double") / v), F.lit(0.0))


def with_engagement(df, views: str = "view_count", likes: str = "likes", comments: str = "comment_count"):
    """P5: add like_rate and comment_rate (0.0 when views are missing or <= 0)."""
    if views not in df.columns:
        return df
    like = rate(likes, views) if likes in df.columns else F.lit(0.0)
    comm = rate(comments, views) if comments in df.columns else F.lit(0.0)
    return df.withColumn("like_rate", like).withColumn("comment_rate", comm)
