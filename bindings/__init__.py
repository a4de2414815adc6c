"""Binding of the operators to the supplied tables, with their reference SQL."""
