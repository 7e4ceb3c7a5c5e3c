"""Logging: each line of a message has the prefix; the level comes from the configuration or from QUILLMASK_LOG_LEVEL."""

from __future__ import annotations

import logging
import os


class Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        head = f"{self.formatTime(record)} {record.levelname} {record.name}: "
        said = record.getMessage()
        if record.exc_info:
            said += "\n" + self.formatException(record.exc_info)
        return "\n".join(head + line for line in said.split("\n"))


def set_up(level: str | None = None) -> logging.Logger:
    """The library's logger, at a level by name (any case); unknown names are errors. Called again, it sets the level anew."""
    name = (level or os.environ.get("QUILLMASK_LOG_LEVEL") or "INFO").upper()
    if name not in logging.getLevelNamesMapping():
        raise ValueError(f"unknown log level {name}")
    logger = logging.getLogger("quillmask")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(Lines())
        logger.addHandler(handler)
    logger.setLevel(name)
    return logger
