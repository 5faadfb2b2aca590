"""Every registered query of the package."""

from facsimile.catalog import checks, damage, documents, draws, files, learning, packs, privacy, profiles  # noqa: F401
from facsimile.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
