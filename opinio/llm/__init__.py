"""Operators of a training-data pipeline (secret scans, tokenisation, line and
near-duplicate removal, toxicity, quality, URL filters, decontamination).

Nothing else in the library imports this subpackage.  ``registry`` holds the
registered queries and their SQL.
"""
