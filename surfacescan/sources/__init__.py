"""Package trees and archives as tables of files."""

from .archive import read_archives, tar_entries, validate_entries  # noqa: F401
from .tree import from_memory, read_tree  # noqa: F401
