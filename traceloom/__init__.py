"""Agent-trace analytics as PySpark DataFrame functions.

Tables in, tables out. ``sources`` reads and writes tables, ``functions`` holds
column expressions, ``operators`` holds the table operators, ``streaming`` the
Structured Streaming forms and ``plans`` the registered queries.
"""
