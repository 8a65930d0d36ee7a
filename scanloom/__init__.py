"""Spark-native risk scanning of code and text tables.

Entry points: ``scanloom.plans.scan`` for one call over a files table; the
modules in ``operators`` for the single steps.
"""
