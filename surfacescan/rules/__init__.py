"""Rule base: data, validation, storage with a checksum, and lookup tables."""

from .base import RuleBase, default_rules, load, save, validate_rules  # noqa: F401
from .written import read_rule, with_rules  # noqa: F401
