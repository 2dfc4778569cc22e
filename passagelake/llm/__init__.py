"""Operators for training-data pipelines: quality, toxicity, de-duplication,
decontamination, WARC, token counts, mixing, HTML extraction, filter audits and
document fingerprints.

Nothing outside this subpackage imports it.
"""
