"""Training-data operators: deduplication, filtering, extraction, mixing.

Nothing else in ``sparkloom`` imports this subpackage.
"""
