"""Table-level operators: ``DataFrame(s) + parameters -> DataFrame``."""
