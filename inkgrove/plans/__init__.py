"""Physical-plan helpers: lineage cuts, size checks, order-based operators."""
