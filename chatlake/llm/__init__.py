"""Training-data pipeline operators.

Every operator is ``DataFrame(s) + parameters -> DataFrame``.  Nothing else in
the library imports this subpackage; ``__spark_entry__`` adds its queries only
when it is present.
"""
