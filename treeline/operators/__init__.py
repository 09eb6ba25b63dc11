"""Tree steps, predicates, search and graph operators."""
