"""Readers, sinks, gated publishing and the keyed upsert."""
