"""Queries that run the operators over whole tables, each with SQL that gives the same rows."""
