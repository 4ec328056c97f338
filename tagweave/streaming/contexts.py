"""Compression contexts over a stream: the same operator as in batch, with state for each context."""

from tagweave.operators.compression import contexts_in_stream

__all__ = ["contexts_in_stream"]
