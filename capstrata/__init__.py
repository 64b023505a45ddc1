"""Capture analytics as Spark DataFrame operators.

Every table is keyed by ``capture_id``; every operator is a plain function
``op(df..., policy) -> DataFrame`` that only declares a plan.
"""
