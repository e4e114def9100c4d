"""Structured lines of the engine over the standard logging module: silent until set up."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

ROOT = "tessera"
#: Terminal colours of the levels.
COLOURS = {"DEBUG": "\x1b[36m", "INFO": "\x1b[32m", "WARNING": "\x1b[33m", "ERROR": "\x1b[31m"}
logging.getLogger(ROOT).addHandler(logging.NullHandler())


class Lines(logging.Formatter):
    """One line with colour, time and prefix, followed by the data; or one JSON object a line."""

    def __init__(self, pretty: bool = True):
        super().__init__()
        self.pretty = pretty

    def format(self, record: logging.LogRecord) -> str:
        when = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        prefix = record.name.removeprefix(ROOT).removeprefix(".").replace(".", ":")
        data = getattr(record, "data", None)
        if record.exc_info and record.exc_info[1] is not None:
            data = {"error": str(record.exc_info[1]), "name": record.exc_info[0].__name__, **({"data": data} if data is not None else {})}
        if not self.pretty:
            return json.dumps(
                {"timestamp": when, "level": record.levelname.lower(), "prefix": prefix, "message": record.getMessage(), "data": data},
                default=str
            )
        head = f"{COLOURS.get(record.levelname, '')}{record.levelname:<5}\x1b[0m {when} {f'[{prefix}] ' if prefix else ''}{record.getMessage()}"
        return head if data is None else head + "\n" + json.dumps(data, indent=2, default=str)


def set_up(level: str = "INFO", pretty: bool = True, stream=None) -> logging.Logger:
    """Write the engine's lines of a level and above to a stream (standard error): standard output stays free for results."""
    log = logging.getLogger(ROOT)
    for h in [h for h in log.handlers if not isinstance(h, logging.NullHandler)]:
        log.removeHandler(h)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(Lines(pretty))
    log.addHandler(handler)
    log.setLevel(level.upper())
    log.propagate = False
    return log


def logger(prefix: str = "") -> logging.Logger:
    """The logger of a part of the engine; data goes in `extra={"data": ...}`."""
    return logging.getLogger(f"{ROOT}.{prefix}" if prefix else ROOT)
