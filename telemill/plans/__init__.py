"""Plan helpers: cutting lineage, size-checked joins."""
