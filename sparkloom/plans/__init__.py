"""Query catalogue: programs over the test tables, with their SQL."""
