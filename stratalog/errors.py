"""What can go wrong, by kind."""


class StoreError(Exception):
    """Base of all errors that this package raises."""


class InvalidInput(StoreError, ValueError):
    """A key, a layer or an argument breaks a rule of the data model."""


class CorruptLog(StoreError):
    """A log record is damaged in a way that a torn final write can't explain."""


class CorruptLayer(StoreError):
    """A layer, its manifest or its Bloom filter doesn't hold what it should."""


class Conflict(StoreError):
    """Another writer has committed this version already."""


class Lagged(StoreError):
    """A feed has come so late that events it should give are deleted."""
