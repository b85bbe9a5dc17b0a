"""Plans made of the operators: the scan, and the query catalogue over the corpus tables."""
