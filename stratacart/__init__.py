"""Layered commerce analytics on Spark: raw tables to checked facts to datamarts."""
