"""Plans of graphloom: the registered queries."""

from . import blocks, graph, inputs, scalars
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blocks", "graph", "inputs", "scalars"]
