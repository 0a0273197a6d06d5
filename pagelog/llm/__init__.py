"""Training-data operators: scans, extraction, de-duplication, packing and classification of texts.

Nothing else in the library imports this package; it may be removed as a whole.
"""
