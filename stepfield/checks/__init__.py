"""All registered queries; importing the modules fills the registry."""

from stepfield.checks.base import QUERIES, SQL
from stepfield.checks import columns, meshes, probing, runs, snapshots, stores, streams, surfaces  # noqa: F401

__all__ = ["QUERIES", "SQL"]
