"""Queries over the driver's tables."""

from . import families  # noqa: F401  adds its queries to the catalogue
