"""Versioned keyed tables, predicates and maintenance jobs as plain Spark plans."""
