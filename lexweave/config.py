"""Settings of the service: defaults, then a JSON file, then environment variables; each value is checked where it enters."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from lexweave.functions.formats import DEFAULT_PROVIDER, OWN_FORMAT, PRICES

PREFIX = "LEXWEAVE_"
POSITIVE = {"chunk_size", "llm_timeout", "subprocess_timeout", "webhook_timeout", "ocr_dpi", "max_input_bytes", "workers"}
NOT_NEGATIVE = {"overlap_sentences", "max_retries", "retry_base_delay", "webhook_retries"}
SHARES = {"language_confidence": 1.0, "similarity_threshold": 100.0}


@dataclass(frozen=True)
class Config:
    llm: str = "cursor:composer-2.5"
    target_lang: str = "en"
    export_format: str | None = None
    runs_dir: str = "runs"
    chunk_size: int = 2500
    overlap_sentences: int = 2
    similarity_threshold: float = 92.0
    language_confidence: float = 0.85
    workers: int = 4
    max_input_bytes: int = 20_000_000
    max_retries: int = 5
    retry_base_delay: float = 1.0
    llm_timeout: float = 300.0
    subprocess_timeout: float = 300.0
    webhook_timeout: float = 30.0
    webhook_retries: int = 3
    ocr_dpi: int = 150
    fail_on_empty_extraction: bool = True
    webhook_url: str | None = None
    webhook_https_only: bool = False
    glossary: str | None = None
    unknown: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        provider, _, model = self.llm.partition(":") if ":" in self.llm else (DEFAULT_PROVIDER, ":", self.llm)
        full = f"{provider.strip().lower()}:{model.strip()}"
        if not model.strip() or (not full.startswith(DEFAULT_PROVIDER + ":") and full not in PRICES):
            raise ValueError(f"unknown llm: {self.llm}")
        object.__setattr__(self, "llm", full)
        object.__setattr__(self, "target_lang", self.target_lang.strip().lower())
        if not re.fullmatch("[a-z]{2}", self.target_lang):
            raise ValueError("target_lang must be a two-letter code")
        if self.export_format is not None and self.export_format not in OWN_FORMAT:
            raise ValueError(f"unknown export_format: {self.export_format}")
        for name in POSITIVE | NOT_NEGATIVE:
            value = getattr(self, name)
            if value < 0 or (name in POSITIVE and value == 0):
                raise ValueError(f"{name} is too small: {value}")
        for name, most in SHARES.items():
            if not 0 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from 0 to {most:g}")
        if self.webhook_url is not None and not re.match("https://" if self.webhook_https_only else "https?://", self.webhook_url):
            raise ValueError("webhook_url has the wrong scheme")

    def runs_path(self, root: str) -> Path:
        return Path(self.runs_dir) if os.path.isabs(self.runs_dir) else Path(root) / self.runs_dir


def _typed(name: str, value: object) -> object:
    kind = next(f.type for f in fields(Config) if f.name == name)
    if isinstance(value, str):
        value = value.strip()
        if value == "":
            return getattr(Config(), name)  # empty stands for the default
        if kind == "bool":
            if value.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                raise ValueError(f"{name} is no truth value: {value}")
            return value.lower() in ("1", "true", "yes", "on")
        if kind in ("int", "float"):
            return int(value) if kind == "int" else float(value)
    return value


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Config:
    """The settings; keys of the file that are none are listed in ``unknown`` and have no effect."""
    names = {f.name for f in fields(Config)} - {"unknown"}
    given = {} if path is None else json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(given, dict):
        raise ValueError("the settings file must hold a JSON object")
    env = os.environ if environment is None else environment
    own = {k: v for k, v in given.items() if k in names} | {k: env[PREFIX + k.upper()] for k in names if PREFIX + k.upper() in env}
    return replace(Config(), **{k: _typed(k, v) for k, v in own.items() if v is not None}, unknown=tuple(sorted(set(given) - names)))
