"""Audits of web pages as Spark queries, across many sites at once."""
