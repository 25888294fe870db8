"""Training-data pipeline operators: deduplication, quality, scoring, mixing and output.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
