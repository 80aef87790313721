"""tidegrid: panel time-series analytics expressed as Spark DataFrame plans."""

from tidegrid.axis import Axis

__all__ = ["Axis"]
