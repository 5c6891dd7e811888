"""DataFrame-to-DataFrame operators; every one takes the entity ``keys``."""
