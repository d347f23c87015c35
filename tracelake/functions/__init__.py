"""Part of the trace-trigger engine."""
