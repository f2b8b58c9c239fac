"""Fields, predicates and coercions as columns."""
