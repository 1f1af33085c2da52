"""Driver loops and the catalog of queries."""
