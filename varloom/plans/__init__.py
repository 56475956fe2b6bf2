"""Plan helpers: lineage cuts, size-checked joins, interval and ordered joins."""
