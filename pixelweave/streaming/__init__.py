"""Incremental runs: work through what has landed since the last run."""

from pixelweave.streaming.incremental import process_landed

__all__ = ["process_landed"]
