"""SRC-CONF: a run's settings from a TOML file, read by the driver alone."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace

#: Each setting's key in the file.
KEYS = {"lang_in": "lang-in", "lang_out": "lang-out", "model": "openai-model", "base_url": "openai-base-url", "system_prompt": "custom-system-prompt", "glossary_files": "glossary-files", "qps": "qps"}


@dataclass(frozen=True)
class Settings:
    lang_in: str = "en"
    lang_out: str = "zh-CN"
    model: str = ""
    base_url: str | None = None
    system_prompt: str = ""
    glossary_files: tuple[str, ...] = ()
    qps: int = 1
    batch_size: int = 6


def read_settings(path: str, section: str = "folioframe", **overrides) -> Settings:
    """Settings of a file; what it lacks has its default, an override that is None counts as absent.
    They stand in the section, or at the top of a file without it.

    Glossary files are a list, or one text parted by commas. A rate of 0 is 1.
    """
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    raw = raw.get(section, raw)
    found = {name: raw[key] for name, key in KEYS.items() if key in raw}
    if "glossary_files" in found:
        files = found["glossary_files"]
        found["glossary_files"] = tuple(p.strip() for p in (files.split(",") if isinstance(files, str) else files or ()) if p.strip())
    if "qps" in found:
        found["qps"] = int(found["qps"] or 1)
    return replace(Settings(**found), **{k: v for k, v in overrides.items() if v is not None})
