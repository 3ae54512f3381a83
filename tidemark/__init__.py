"""tidemark: timestamped key/value tables with last-write-wins semantics, as Spark DataFrames."""

from tidemark.model import RECORD, Options, TidemarkError
from tidemark.store import Store

__all__ = ["RECORD", "Options", "Store", "TidemarkError"]
