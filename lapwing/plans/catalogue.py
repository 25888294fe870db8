"""Every registered query of the signal engine, and its SQL where SQL can express it."""

from __future__ import annotations

from lapwing.plans import coding_queries, curve_queries, decode_queries, layout_queries, prediction_queries, signal_queries, stream_queries, tiling_queries, training_queries, vector_queries

QUERIES = signal_queries.QUERIES | vector_queries.QUERIES | coding_queries.QUERIES | stream_queries.QUERIES | layout_queries.QUERIES | decode_queries.QUERIES | tiling_queries.QUERIES | curve_queries.QUERIES | training_queries.QUERIES | prediction_queries.QUERIES
ORACLE = signal_queries.ORACLE | vector_queries.ORACLE | coding_queries.ORACLE | stream_queries.ORACLE | layout_queries.ORACLE | decode_queries.ORACLE | tiling_queries.ORACLE | curve_queries.ORACLE | training_queries.ORACLE | prediction_queries.ORACLE
