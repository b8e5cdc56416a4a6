"""Parley: conversation archives as Spark tables."""

from parley.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
