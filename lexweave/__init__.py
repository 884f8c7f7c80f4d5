"""Documents translated and checked, and corpora built, on Spark.  The names below are imported when they are first used."""

from __future__ import annotations

from importlib import import_module

_PUBLIC = {
    "run": "plans.service", "resume": "plans.service", "Options": "plans.service", "Results": "plans.service",
    "Asking": "operators.completion", "asking": "operators.completion", "client": "operators.completion", "counted": "operators.completion", "mock": "operators.completion",
    "translate_documents": "operators.translate", "profile": "operators.ngrams", "detect": "operators.ngrams", "chunk": "operators.chunking", "reassemble": "operators.chunking",
    "extract": "sources.files", "memo": "sinks.memo", "tracked": "streaming.tracker", "settled": "streaming.tracker",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *_PUBLIC})
