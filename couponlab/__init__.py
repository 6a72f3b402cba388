"""Coupon redemption analytics as Spark DataFrame jobs.

Layout: ``sources`` (readers, adapters, sinks), ``functions`` (column
expressions), ``operators`` (feature, split, profiling, evaluation and model
jobs) and ``plans`` (whole data sets built from the operators).
"""
