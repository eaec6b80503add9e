"""Plans: bindings of operators to tables, the mode matrix, artifacts."""
