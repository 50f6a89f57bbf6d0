"""Column-level building blocks: keyed randomness, scalar helpers and value pools."""
