"""Driver log: Python logging with the tags and layout users know.

Results are never logged; they are rows of the result table.
"""

from __future__ import annotations

import logging
from datetime import datetime

# Levels by name. LIVE is progress, PANIC the gravest.
LEVELS = {"LIVE": 21, "INFO": 20, "WARN": 30, "DEBUG": 10, "ERROR": 40, "FATAL": 50, "PANIC": 60}
NAME = "readsieve"

for _tag, _level in LEVELS.items():
    logging.addLevelName(_level, _tag)


class _Layout(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        t = datetime.fromtimestamp(record.created)
        return f"{t:%Y.%m.%d-%H:%M:%S}.{t.microsecond // 10_000:02d} - [{record.levelname}] {record.getMessage()}"


def default_file(now: datetime | None = None) -> str:
    return f"{now or datetime.now():./readsieve-%Y-%m-%d-%H%M.log}"


def start(path: str | None = None, *, level: str = "DEBUG", dated: bool = False, silent: bool = False) -> logging.Logger:
    """Log to the console and, with ``path``, to a file that is appended to.

    ``dated`` puts the day into the file name; ``silent`` drops LIVE and DEBUG.
    """
    log = logging.getLogger(NAME)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    log.setLevel(LEVELS[level])
    log.propagate = False
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path is not None:
        handlers.append(logging.FileHandler(f"{path}-{datetime.now():%Y-%m-%d}" if dated else path))
    for handler in handlers:
        handler.setFormatter(_Layout())
        if silent:
            handler.addFilter(lambda r: r.levelno not in (LEVELS["LIVE"], LEVELS["DEBUG"]))
        log.addHandler(handler)
    return log


def live(message: str, *values) -> None:
    logging.getLogger(NAME).log(LEVELS["LIVE"], message, *values)
