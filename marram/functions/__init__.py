"""Expression builders used by several operators."""
