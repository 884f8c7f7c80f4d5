"""Logs as text or JSON lines, and listeners to the issues of jobs."""

from __future__ import annotations

import json
import logging
import logging.config
import sys
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row

NAME = "lexweave"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
STANDARD = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

Listener = Callable[[Row], None]


#: What a JSON line says of a record before its extra fields; what is null is left out.
FIELDS: dict[str, Callable[[logging.LogRecord], str | None]] = {
    "timestamp": lambda r: datetime.fromtimestamp(r.created, timezone.utc).isoformat(),
    "level": lambda r: r.levelname,
    "logger": lambda r: r.name,
    "message": logging.LogRecord.getMessage,
    "exception": lambda r: logging.Formatter().formatException(r.exc_info) if r.exc_info else None,
}
# Fixed value: the layout of a line of text.
LINE = "%(asctime)s [%(levelname)s] %(name)s: %(message)s"


class JsonLines(logging.Formatter):
    """A record as one JSON object: FIELDS and every extra field that has a value."""

    def format(self, record: logging.LogRecord) -> str:
        extra = {k: v for k, v in vars(record).items() if k not in STANDARD}
        said = {name: of(record) for name, of in FIELDS.items()} | extra
        return json.dumps({k: v for k, v in said.items() if v is not None}, default=str)


def configure(level: str = "info", as_json: bool = False, stream=None) -> logging.Logger:
    """The library's logger with one handler; an unknown level is info."""
    known = LEVELS.get(level.lower().replace("warning", "warn"), logging.INFO)
    logging.config.dictConfig({
        "version": 1,
        "disable_existing_loggers": False,
        "formatters": {"text": {"format": LINE}, "json": {"()": JsonLines}},
        "handlers": {NAME: {"class": "logging.StreamHandler", "stream": stream or sys.stderr, "formatter": "json" if as_json else "text"}},
        "loggers": {NAME: {"level": known, "handlers": [NAME], "propagate": False}},
    })
    return logging.getLogger(NAME)


def logging_listener() -> Listener:
    log = logging.getLogger(NAME)

    def tell(issue: Row) -> None:
        extra = {"job_id": issue["job_id"], "issue_code": issue["code"], "stage": issue["stage"]}
        log.log(LEVELS.get(issue["severity"], logging.WARNING), issue["message"], extra=extra)

    return tell


def tracker_listener(dsn: str, severities: Iterable[str] = ("error",), release: str | None = None) -> Callable[[], Listener]:
    """A factory of listeners to an error tracker: each issue leaves a breadcrumb, those of the severities an event.  Without its package: nothing."""
    chosen = frozenset(severities)

    def make() -> Listener:
        try:
            import sentry_sdk
        except ImportError:
            return lambda issue: None
        sentry_sdk.init(dsn=dsn, release=release, send_default_pii=False)

        def tell(issue: Row) -> None:
            level = {"warn": "warning"}.get(issue["severity"], issue["severity"])
            sentry_sdk.add_breadcrumb(category="pipeline.issue", message=issue["message"], level=level, data={"code": issue["code"], "stage": issue["stage"], "job_id": issue["job_id"]})
            if issue["severity"] in chosen:
                with sentry_sdk.new_scope() as scope:
                    scope.set_tag("job_id", issue["job_id"])
                    scope.set_tag("issue_code", issue["code"])
                    sentry_sdk.capture_message(issue["message"], level=level, scope=scope)

        return tell

    return make


def announce(issues: DataFrame, listeners: Iterable[Callable[[], Listener]]) -> None:
    """Tells every listener every issue, in the tasks that have them; a listener is made once a task, and its failures are logged and no more."""
    factories = list(listeners)

    def tell(rows: Iterable[Row]) -> None:
        made = [f() for f in factories]
        for row in rows:
            for listener in made:
                try:
                    listener(row)
                except Exception:  # noqa: BLE001  a listener never fails a job
                    logging.getLogger(NAME).exception("a listener failed")

    issues.foreachPartition(tell)
