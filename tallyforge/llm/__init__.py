"""Operators for preparing training corpora: counting, sharding, mixing, cleaning and deduplicating documents."""
