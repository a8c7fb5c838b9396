"""Messages about what sources and sinks do on the driver."""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("quillrow")


@contextmanager
def debugging(level: int = logging.DEBUG, stream=None) -> Iterator[logging.Logger]:
    """Shows the package's messages from a level on, to standard error or a stream, until the block ends."""
    handler, before = logging.StreamHandler(stream or sys.stderr), LOG.level
    handler.setFormatter(logging.Formatter("%(name)s %(levelname)s %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(level)
    try:
        yield LOG
    finally:
        LOG.removeHandler(handler)
        LOG.setLevel(before)
