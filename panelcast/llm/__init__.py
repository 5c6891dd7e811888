"""Operators that prepare text for training: output files, scans, fingerprints, dedup, chat, tokens, scoring, packing."""
