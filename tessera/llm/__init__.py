"""Operators for preparing training corpora: archive, dedup, tokens, search, filters.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the
repository top and ``__spark_entry__.py`` (guarded) are its only users.
"""
