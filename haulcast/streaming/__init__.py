"""Silver on a stream."""

from haulcast.streaming.silver import start_silver  # noqa: F401
