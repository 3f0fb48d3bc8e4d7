"""Batch analytics over multichannel time-series segments, and judging of classifiers on them, as Spark plans."""
