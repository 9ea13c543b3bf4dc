"""Column-level helpers: type predicates, aggregate expressions, tail probabilities."""
