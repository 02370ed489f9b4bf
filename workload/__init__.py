"""The request log derived from the given tables, and its SQL check queries."""
