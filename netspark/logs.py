"""Logging of the library: loggers under ``netspark``, files, JSON records, timers."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
import time
from pathlib import Path
from typing import Any

ROOT = "netspark"
FORMAT, DATES = "%(asctime)s %(name)s %(levelname)s %(message)s", "%Y-%m-%d %H:%M:%S"
_STANDARD = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}
_TIMED = ("took", "duration", "seconds", "performance", "memory", "elapsed")


class JSONFormatter(logging.Formatter):
    """One JSON object a record; extra fields come along."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "module": record.module, "function": record.funcName, "line": record.lineno}
        out |= {k: v for k, v in vars(record).items() if k not in _STANDARD}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


class PerformanceFilter(logging.Filter):
    """Passes only records whose message speaks of time or memory."""

    def __init__(self, keywords: tuple[str, ...] = _TIMED):
        super().__init__()
        self.keywords = keywords

    def filter(self, record: logging.LogRecord) -> bool:
        message = record.getMessage().lower()
        return any(k in message for k in self.keywords)


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(name if name == ROOT or name.startswith(ROOT + ".") else f"{ROOT}.{name}")


def setup_logging(level: str | int | None = None, log_file: str | None = None, log_dir: str | None = None, console: bool | None = None, json_format: bool | None = None, performance_logging: bool | None = None, format_string: str | None = None, date_format: str | None = None, max_file_size: int | None = None, backup_count: int | None = None, force_setup: bool = False) -> logging.Logger:
    """Set up the library's root logger once, or again if forced.

    What isn't given comes from NETSPARK_LOG_LEVEL, NETSPARK_LOG_FILE,
    NETSPARK_LOG_DIR, NETSPARK_LOG_CONSOLE and NETSPARK_LOG_JSON.
    """
    logger, env = logging.getLogger(ROOT), os.environ.get
    if logger.handlers and not force_setup:
        return logger
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()

    def flag(value: bool | None, name: str, default: bool) -> bool:
        return value if value is not None else env(name, str(default)).lower() in ("1", "true", "yes", "on")

    level = level if level is not None else env("NETSPARK_LOG_LEVEL", "INFO")
    logger.setLevel(level.upper() if isinstance(level, str) else level)
    formatter = JSONFormatter() if flag(json_format, "NETSPARK_LOG_JSON", False) else logging.Formatter(format_string or FORMAT, date_format or DATES)
    handlers: list[logging.Handler] = [logging.StreamHandler()] if flag(console, "NETSPARK_LOG_CONSOLE", True) else []
    folder, name = log_dir or env("NETSPARK_LOG_DIR"), log_file or env("NETSPARK_LOG_FILE")
    if folder or name:
        path = Path(folder or ".") / (name or "netspark.log")
        path.parent.mkdir(parents=True, exist_ok=True)
        sizes = {"maxBytes": max_file_size or 10 * 2**20, "backupCount": 5 if backup_count is None else backup_count}
        handlers.append(logging.handlers.RotatingFileHandler(path, **sizes))
        if performance_logging:
            timed = logging.handlers.RotatingFileHandler(path.with_name(path.stem + "_performance" + path.suffix), **sizes)
            timed.addFilter(PerformanceFilter())
            handlers.append(timed)
    for h in handlers or [logging.NullHandler()]:
        h.setFormatter(formatter)
        logger.addHandler(h)
    logger.propagate = False
    return logger


def configure_external_library_logging(libraries: dict[str, str] | list[str] | None = None, suppress_verbose: bool = True) -> None:
    """Set levels of other libraries' loggers; by default the usual talkative ones go to WARNING."""
    wanted = libraries if libraries is not None else ["py4j", "pyspark", "urllib3", "matplotlib"]
    levels = wanted if isinstance(wanted, dict) else {x: "WARNING" if suppress_verbose else "INFO" for x in wanted}
    for name, level in levels.items():
        logging.getLogger(name).setLevel(level)


def log_function_entry(func_name: str, **kwargs: Any) -> None:
    get_logger(ROOT).debug("enter %s(%s)", func_name, ", ".join(f"{k}={v!r}" for k, v in kwargs.items()))


def log_performance_metric(operation: str, duration: float, details: dict | None = None) -> None:
    get_logger(ROOT).info("%s took %.3f seconds%s", operation, duration, "".join(f", {k}={v}" for k, v in (details or {}).items()))


class LoggingTimer:
    """``with LoggingTimer("step"):`` logs how long the block took; ``duration`` has it."""

    def __init__(self, operation: str, logger: logging.Logger | None = None, level: int = logging.INFO):
        self.operation, self.logger, self.level, self.duration = operation, logger or get_logger(ROOT), level, None

    def __enter__(self) -> LoggingTimer:
        self.began = time.perf_counter()
        return self

    def __exit__(self, exc_type: type | None, exc_val: BaseException | None, exc_tb: Any) -> None:
        self.duration = time.perf_counter() - self.began
        self.logger.log(self.level, "%s %s after %.3f seconds", self.operation, "failed" if exc_type else "took, ended", self.duration)
