"""Queries over the test tables with SQL that must give the same rows."""
