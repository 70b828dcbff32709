"""Where messages of the package go, and from which level on.

Python's ``logging`` under the name ``tracelake``.  Only this process is set up; executors log as
Spark has them do.
"""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from logging.handlers import TimedRotatingFileHandler

from tracelake.errors import LimitError

TRACE = 5
logging.addLevelName(TRACE, "TRACE")
LEVELS = {
    "trace": TRACE,
    "debug": logging.DEBUG,
    "info": logging.INFO,
    "warning": logging.WARNING,
    "error": logging.ERROR,
    "critical": logging.CRITICAL,
    "off": logging.CRITICAL + 1,
}
KINDS = ("console", "file", "visual studio")
FILE = "logs/tracelake.txt"
log = logging.getLogger("tracelake")


def _handler(kind: str, path: str) -> logging.Handler:
    if kind == "file":
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return TimedRotatingFileHandler(path, when="midnight", encoding="utf-8", delay=True)
    return logging.StreamHandler(sys.stdout if kind == "console" else sys.stderr)


def set_logger(kind: str, level: str, path: str = FILE) -> None:
    """Send messages from ``level`` on to standard output (console), a file that a new one follows
    every midnight (file) or standard error (visual studio), instead of where they went.  An
    unknown kind or level is a limit error and changes nothing."""
    for x, known in ((kind, KINDS), (level, LEVELS)):
        if x not in known:
            raise LimitError(f"{x!r} is none of {', '.join(known)}")
    new = _handler(kind, path)
    new.setFormatter(logging.Formatter("[%(asctime)s] [%(name)s] [%(levelname)s] %(message)s"))
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    log.addHandler(new)
    log.setLevel(LEVELS[level])
    log.propagate = False
    log.info("%s logger, level %s", kind, level)


def message(level: str, text: str) -> None:
    """Log a message of one's own."""
    if level not in LEVELS or level == "off":
        raise LimitError(f"no level {level!r}")
    log.log(LEVELS[level], text)


@contextmanager
def logged(kind: str, level: str, path: str = FILE) -> Iterator[None]:
    """:func:`set_logger` for the length of a block; then all is as it was before."""
    before, levels, up = list(log.handlers), log.level, log.propagate
    for h in before:
        log.removeHandler(h)
    try:
        set_logger(kind, level, path)
        yield
    finally:
        for h in list(log.handlers):
            log.removeHandler(h)
            h.close()
        for h in before:
            log.addHandler(h)
        log.setLevel(levels)
        log.propagate = up
