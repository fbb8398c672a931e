"""Queries: operators over the tables, each with SQL that gives the same rows."""
