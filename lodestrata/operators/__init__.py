"""Pure DataFrame operators: filters, catalog transitions, statistics and plans of side effects."""
