"""Millrace: hybrid text retrieval and grounded-answer analytics on PySpark."""
