"""tagweave: tagged-item encoding, framing, schemas and corpus preparation as DataFrame operators."""

__version__ = "0.1.0"
