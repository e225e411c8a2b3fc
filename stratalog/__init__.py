"""Versioned keyed data on Spark: logs of puts and deletes, immutable layers, newest-wins reads."""

from stratalog.errors import Conflict, CorruptLayer, CorruptLog, InvalidInput, Lagged, StoreError

__all__ = ["Conflict", "CorruptLayer", "CorruptLog", "InvalidInput", "Lagged", "StoreError"]
