"""Reliable checkpoints in the folder that the cluster names: the library's own, for all operators here."""

from simgraph.runtime import checkpoint_path, cut, prepare

__all__ = ["checkpoint_path", "cut", "prepare"]
