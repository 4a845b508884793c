"""Reports and multi-operator jobs composed from the operators."""
