"""Structured Streaming: files as they arrive. An extension; the batch operators are used as they are."""
