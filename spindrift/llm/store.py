"""Where intermediate tables go; see the library's store."""

from ..sources.store import clear, new_folder, shared_root, stored, unused

__all__ = ["clear", "new_folder", "shared_root", "stored", "unused"]
