"""Functions for SQL: each is an expression that Catalyst inlines, registered for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body).
FUNCTIONS = {
    "byte_tokens": ("data STRING", "ARRAY<INT>", "CASE WHEN octet_length(data) > 0 THEN transform(split(decode(CAST(data AS BINARY), 'ISO-8859-1'), ''), c -> ascii(c)) ELSE CAST(array() AS ARRAY<INT>) END"),
    "tokens_digest": ("tokens ARRAY<INT>", "STRING", "sha2(array_join(CAST(tokens AS ARRAY<STRING>), ','), 256)"),
    "window_id": ("position BIGINT, n_ctx BIGINT, overlap BIGINT", "BIGINT", "greatest(0L, CAST(floor((position - overlap) / (n_ctx - overlap)) AS BIGINT))"),
    "silu": ("x DOUBLE", "DOUBLE", "x / (1 + exp(-x))"),
    "round_half_even": ("x DOUBLE", "BIGINT", "CAST(rint(x) AS BIGINT)"),
    "exclusive_sum": ("freqs ARRAY<BIGINT>, symbol INT", "BIGINT", "aggregate(slice(freqs, 1, symbol), 0L, (s, x) -> s + x)"),
    "bits_of": ("freq BIGINT, total BIGINT", "DOUBLE", "-log2(freq / total)"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions for the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS]
