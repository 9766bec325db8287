"""Run tables, field snapshots and meshes as Spark DataFrames."""

from stepfield.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
