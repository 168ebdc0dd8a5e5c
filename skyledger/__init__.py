"""Image-footprint catalog analytics on Spark DataFrames."""

from skyledger.schema import CATALOG_SCHEMA
from skyledger.session import get_session

__all__ = ["CATALOG_SCHEMA", "get_session"]
