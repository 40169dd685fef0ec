"""Spark-native building, auditing and evaluation of labelled trace corpora."""
