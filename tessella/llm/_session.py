"""The folder that driver and executors share, and tables written there to cut lineage."""

from tessella.session import scratch, shared_dir, written

__all__ = ["scratch", "shared_dir", "written"]
