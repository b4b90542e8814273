"""Reconciles inconsistent tabular exports into one declared contract, as Spark jobs."""
