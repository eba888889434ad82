"""Report queries, and bindings of the operators to the star-schema tables."""
