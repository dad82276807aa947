"""Structured events as lines of JSON."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime
from logging.handlers import RotatingFileHandler
from pathlib import Path

MAX_BYTES, BACKUPS = 10 * 1024 * 1024, 5


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        event = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "event": record.getMessage()}
        return json.dumps(event | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def event_log(path: str, name: str = "cuewright") -> logging.Logger:
    """A logger that writes each event as a line, in files of ten megabytes, five of them kept."""
    logger = logging.getLogger(f"{name}.{Path(path).resolve()}")
    if not logger.handlers:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handler = RotatingFileHandler(path, maxBytes=MAX_BYTES, backupCount=BACKUPS, encoding="utf-8")
        handler.setFormatter(_Json())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger
