"""Structured Streaming: continuous conversion with the registry carried from batch to batch."""

from .carrier import convert_stream

__all__ = ["convert_stream"]
