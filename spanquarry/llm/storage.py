"""Intermediate tables of this subpackage: those of the whole library, see ``sources.shared``."""

from spanquarry.sources.shared import BATCH_ROWS, Scratch, shared_dir, small_batches

__all__ = ["BATCH_ROWS", "Scratch", "shared_dir", "small_batches"]
