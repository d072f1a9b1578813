"""Tables between the passes of an operator, in the folder that driver and executors share."""

from ..sources.staging import drop, drop_since, folder, mark, table

__all__ = ["drop", "drop_since", "folder", "mark", "table"]
