"""Context windows of token streams in closed form: no position depends on a scan of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_id(position: Column, n_ctx: int, overlap: int) -> Column:
    """The window that scores a position, when a full window starts again at position - overlap."""
    if not 0 <= overlap < n_ctx:
        raise ValueError("0 <= overlap < n_ctx is asked for")
    return F.greatest(F.lit(0), F.floor((position - overlap) / (n_ctx - overlap))).cast("bigint")


def plan_windows(streams: DataFrame, length_col: str, n_ctx: int, overlap: int) -> DataFrame:
    """A row per window: the stream's columns, window, start, score_from and score_to (positions it primes and scores)."""
    last = window_id(F.col(length_col) - 1, n_ctx, overlap)
    out = streams.filter(F.col(length_col) > 0).withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    step = n_ctx - overlap
    start = F.col("window") * step
    first = F.when(F.col("window") == 0, F.lit(0)).otherwise(start + overlap)
    return out.withColumns({"start": start, "score_from": first.cast("bigint"), "score_to": F.least(F.col(length_col).cast("bigint"), start + n_ctx)})


def chunk_targets(tokens: Column, n_ctx: int) -> Column:
    """The tokens that whole chunks of n_ctx are evaluated on: those after the positions n_ctx / 2 to n_ctx - 2 of each."""
    whole = F.floor(F.size(tokens) / n_ctx) * n_ctx
    return F.filter(tokens, lambda t, i: (i % n_ctx > n_ctx // 2) & (i < whole))
