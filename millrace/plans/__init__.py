"""Registered queries: each has a Spark plan and, where SQL can express it, the SQL that gives the same rows."""
