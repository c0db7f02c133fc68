"""Column-level functions: release-name parsing, classification, ids, time, binary keys."""
