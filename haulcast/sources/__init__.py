"""Bronze inputs over the test schema, and sinks."""

from haulcast.sources import bronze  # noqa: F401
