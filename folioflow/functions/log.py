"""Messages of the library, on the standard error stream; those for debugging only if FOLIOFLOW_DEBUG is set."""

from __future__ import annotations

import logging
import os
import sys

DEBUG = "FOLIOFLOW_DEBUG"


class _Stream(logging.StreamHandler):
    """The standard error stream as it is when a message comes."""

    @property
    def stream(self):  # noqa: ANN201
        return sys.stderr

    @stream.setter
    def stream(self, value: object) -> None:
        pass


def logger(name: str) -> logging.Logger:
    """A logger under ``folioflow``; the first one sets up where messages go."""
    top = logging.getLogger("folioflow")
    if not top.handlers:
        handler = _Stream()
        handler.setFormatter(logging.Formatter("[%(levelname)s] %(name)s: %(message)s"))
        top.addHandler(handler)
        top.propagate = False
    top.setLevel(logging.DEBUG if os.environ.get(DEBUG) else logging.INFO)
    return logging.getLogger(f"folioflow.{name}")
