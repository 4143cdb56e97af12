"""Folders for queries that write and read back."""

from spotframe.sources.scratch import new_folder  # noqa: F401
