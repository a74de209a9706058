"""Column builders: text helpers, pattern translation, URI parts and predicates."""
