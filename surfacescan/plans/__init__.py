"""Whole analyses, as plans over the operators."""

from .audit import Audit, audit  # noqa: F401
