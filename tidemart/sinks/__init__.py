"""Topic sinks and keyed, day-partitioned tables."""
