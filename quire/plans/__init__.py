"""Registered queries: importing this package fills quire.registry."""

from . import checking, decisions, evaluation, fusion, pages, printing, sequences, typesetting  # noqa: F401
