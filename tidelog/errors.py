"""What can go wrong, as exceptions."""


class StoreError(Exception):
    """The root of this package's errors."""


class InvalidOptions(StoreError):
    """An option is outside its range."""


class InvalidInput(StoreError):
    """A key or value is larger than allowed."""


class DataCorrupted(StoreError):
    """Bytes don't match their checksum or their format."""

    def __init__(self, what: str, path: str = "", offset: int = 0):
        super().__init__(f"{what} in {path or 'memory'} at byte {offset}")
        self.what, self.path, self.offset = what, path, offset


class ManifestError(StoreError):
    """An edit doesn't fit the state of the manifest."""


class WritesStalled(StoreError):
    """Level 0 holds too many segments, and compaction could not make room in time."""


class ReadOnly(StoreError):
    """An earlier failure made the store read-only; reads go on."""


class DirectoryLocked(StoreError):
    """Another store has the folder open."""
