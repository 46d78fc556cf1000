"""DataFrame -> DataFrame operators; each works with ``df.transform``."""
