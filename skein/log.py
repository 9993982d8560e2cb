"""Logging: one JSON object a line, with the fields given as ``extra={"fields": {...}}``."""

from __future__ import annotations

import json
import logging
import os
import sys
from datetime import UTC, datetime

#: The engine's logger; silent until ``setup``.
logger = logging.getLogger("skein")
logger.addHandler(logging.NullHandler())


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        out |= getattr(record, "fields", {})
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def setup(level: str | None = None, stream=None) -> logging.Logger:
    """The engine's logger, writing JSON lines to ``stream`` (standard error by default), at ``level`` or that of ``SKEIN_LOG_LEVEL``."""
    logger.handlers = [logging.StreamHandler(stream or sys.stderr)]
    logger.handlers[0].setFormatter(JsonFormatter())
    logger.setLevel(level or os.environ.get("SKEIN_LOG_LEVEL", "INFO").upper())
    return logger


def event(name: str, **fields) -> None:
    """Log one event with its fields."""
    logger.info(name, extra={"fields": fields})
