"""Operators for preparing training data at corpus scale (one module per operator).

Nothing else in the library imports this package, and it imports only general helpers from
the rest. ``queries.py`` registers one query per operator, ``oracle.py`` the DuckDB SQL of
those that SQL can express.
"""
