"""Scalar functions as SQL expression text.

Every function takes SQL expressions (usually column names) and returns a SQL expression,
to be used in ``F.expr``, ``selectExpr`` or ``where``.  Text composes into one expression
that Spark parses once, where the same tree built from Column objects would cost thousands
of calls into the JVM per query.
"""
