"""Grounded question answering over text collections as Spark DataFrame plans."""
