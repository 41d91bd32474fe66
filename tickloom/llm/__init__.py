"""Operators for preparing training data: near copies, fingerprints, filters, mixing, packing and formats.

Nothing outside this folder imports it. Workers need the package on their path (`--py-files` on a cluster).
"""
