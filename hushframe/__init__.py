"""Disclosure-controlled analytics on Spark, with the operators beside it."""
