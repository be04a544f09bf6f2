"""Log sinks of the driver: standard output, a daily log kept for a week, an error log kept for a month."""

from __future__ import annotations

import logging
import sys
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path

NAME = "plumbago"


def setup(folder: str, debug: bool = False) -> logging.Logger:
    """The engine's logger; calling it again replaces its sinks."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(NAME)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    form = logging.Formatter("%(asctime)s | %(levelname)-8s | %(name)s:%(funcName)s:%(lineno)d - %(message)s")
    every = TimedRotatingFileHandler(f"{folder}/app.log", when="midnight", backupCount=7, encoding="utf-8")
    errors = TimedRotatingFileHandler(f"{folder}/error.log", when="midnight", backupCount=30, encoding="utf-8")
    errors.setLevel(logging.ERROR)
    for h in (logging.StreamHandler(sys.stdout), every, errors):
        h.setFormatter(form)
        log.addHandler(h)
    return log
