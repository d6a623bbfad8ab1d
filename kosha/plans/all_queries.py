"""Importing this module registers every query of the reference's operators."""

from . import analytics, evaluation, facts, graph, packages, retrieval, sources, streams, text  # noqa: F401
