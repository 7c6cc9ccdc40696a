"""Connected components: the library's own, for all operators here."""

from simgraph.operators.components import components

__all__ = ["components"]
