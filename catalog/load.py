"""Imports every catalog module so that its queries register."""

from . import duplicates, enrich, flows, ingest, quality, scoring, serving, sources, topics  # noqa: F401
