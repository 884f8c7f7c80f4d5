"""Whether the machine has what a job needs: programs, packages, keys, a folder that can be written."""

from __future__ import annotations

import importlib.util
import os
import struct
import tempfile
import zlib
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from lexweave.config import Config
from lexweave.operators.providers import KEYS, URLS
from lexweave.sources.pages import recognise_over_http
from lexweave.sources.programs import program


class Check(NamedTuple):
    name: str
    ok: bool
    required: bool
    message: str

    @property
    def status(self) -> str:
        return "ok" if self.ok else "fail" if self.required else "warn"


def blank_image() -> bytes:
    """A white PNG of one pixel."""

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\x00\xff")) + part(b"IEND", b"")


def _writable(folder: Path) -> str | None:
    try:
        folder.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=folder, prefix=".check-"):
            return None
    except OSError as e:
        return e.strerror or type(e).__name__


def _answers(probe: Callable[[bytes], str]) -> str | None:
    try:
        probe(blank_image())
        return None
    except RuntimeError as e:
        return str(e)


def checks(config: Config, root: str = ".", fmt: str | None = None, ocr: bool = False, ocr_url: str | None = None, layout: bool | None = None, environment: dict[str, str] | None = None) -> list[Check]:
    """``fmt`` None: any format may be asked for; ``layout``: its reader is needed (True), may be used (None) or is not (False)."""
    env = os.environ if environment is None else environment
    out = []

    def add(name: str, problem: str | None, required: bool = True, good: str = "available") -> None:
        out.append(Check(name, problem is None, required, problem or good))

    def tool(name: str, required: bool, why: str) -> None:
        add(name, None if program(name) else f"not installed ({why})", required)

    add("runs_dir", _writable(config.runs_path(root)), good="writable")
    provider = config.llm.split(":")[0]
    add("llm_client", None if provider in URLS else f"{provider} takes a client that the caller gives", provider in URLS)
    add("llm_key", None if env.get(KEYS.get(provider, "")) else f"{KEYS.get(provider, provider)} is not set", good="set")
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        add(name, None if importlib.util.find_spec(name) else "not installed")
    if fmt != "md":
        tool("pandoc", True, "all formats but md")
    if fmt in (None, "pdf"):
        add("weasyprint", None if importlib.util.find_spec("weasyprint") else "not installed (pdf)")
    if ocr_url:
        add("ocr_server", _answers(recognise_over_http(ocr_url, seconds=5.0)), False, f"answers at {ocr_url}")
    if ocr or ocr_url:
        tool("tesseract", ocr and not ocr_url, "recognition of scanned pages")
    if layout is not False:
        tool("imagemagick", bool(layout), "images for the layout reader")
    tool("libreoffice", fmt == "doc" or bool(layout), "doc files, office files for the layout reader")
    return out


def ready(found: list[Check]) -> bool:
    return all(c.ok or not c.required for c in found)
