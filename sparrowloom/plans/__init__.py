"""Registered core queries: each module adds its own when imported."""

from . import dialect, events, logs, records, retrieval, stored, whole, words  # noqa: F401
