"""Column expressions: ``Column -> Column``, no Python UDFs."""
