"""Audits of files as they arrive."""

from .dropbox import stream_archives, stream_matches  # noqa: F401
