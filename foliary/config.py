"""Configurations as frozen dataclasses, and their JSON form."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

MAX_CONFIG_BYTES = 1 << 20


@dataclass(frozen=True)
class RemovalRule:
    """A line to remove: ``literal`` equals the trimmed line, ``key`` equals its family key. Scopes: whole_line, page_top,
    page_bottom, page_top_or_bottom; ``anywhere`` is accepted and has no effect."""

    id: str
    kind: str
    text: str
    scope: str = "whole_line"
    enabled: bool = True
    label: str = ""
    source: str = "user"


@dataclass(frozen=True)
class CleaningConfig:
    """What cleaning does; everything is off by default."""

    normalize_line_endings: bool = False
    replace_diacritics: bool = False
    normalize_unicode: bool = False
    lowercase: bool = False
    remove_page_delimiters: bool = False
    remove_page_indicators: bool = False
    remove_standalone_page_numbers: bool = False
    remove_standalone_roman_page_numbers: bool = False
    remove_obvious_extraction_noise: bool = False
    normalize_irregular_line_breaks: bool = False
    join_line_breaks: bool = False
    trim_lines: bool = False
    collapse_blank_lines: bool = False
    rules: tuple[RemovalRule, ...] = ()
    remove_patterns: tuple[str, ...] = ()
    replace_patterns: tuple[tuple[str, str], ...] = ()

    def with_rules(self, rules: list[RemovalRule]) -> CleaningConfig:
        """The configuration with further rules; a rule whose id, or scope and text, is there already is left out."""
        have = {r.id for r in self.rules} | {(r.scope, r.kind, r.text) for r in self.rules}
        new = []
        for r in rules:
            if r.id not in have and (r.scope, r.kind, r.text) not in have:
                have |= {r.id, (r.scope, r.kind, r.text)}
                new.append(r)
        return replace(self, rules=self.rules + tuple(new))


@dataclass(frozen=True)
class ScanConfig:
    """What the repeated-artefact scan looks for."""

    include_exact_lines: bool = True
    include_normalized_lines: bool = True
    include_two_line_blocks: bool = False
    include_three_line_blocks: bool = False
    include_inline_artifacts: bool = True
    include_text: bool = True
    include_mixed: bool = True
    include_symbol: bool = True
    include_numeric: bool = False
    min_occurrences: int = 5
    min_files: int = 1
    max_candidates: int = 100
    max_examples: int = 25
    min_line_length: int = 4
    max_line_length: int = 300
    max_variants: int = 200


@dataclass(frozen=True)
class IntakeConfig:
    """How pages come in and what is taken out of them. ``text_source``: embedded, ocr or force_ocr; ``strategy``: flat or visual."""

    text_source: str = "embedded"
    ocr_quality: str = "balanced"
    strategy: str = "flat"
    headers: bool = False
    labels: bool = False
    symbols: bool = False
    code: bool = False
    formulas: bool = False


# What each intake preset sets, and which preset each suggestion of a quality audit stands for.
INTAKE_PRESETS: dict[str, IntakeConfig] = {
    "standard": IntakeConfig(),
    "layout": IntakeConfig(strategy="visual", headers=True, labels=True),
    "ocr": IntakeConfig(text_source="ocr", headers=True, labels=True),
    "force-ocr": IntakeConfig(text_source="force_ocr", ocr_quality="high", headers=True, labels=True),
}
PRESET_OF_AUDIT = {"standard": "standard", "layout_heavy": "layout", "ocr_rescue": "ocr", "force_ocr": "force-ocr"}


def to_json(config: Any) -> str:
    return json.dumps(asdict(config), ensure_ascii=False, indent=2)


def cleaning_from_json(text: str) -> CleaningConfig:
    """Absent fields take their defaults, unknown ones and values of a wrong type are left out."""
    raw = json.loads(text)
    known: dict[str, Any] = {}
    for f in fields(CleaningConfig):
        v = raw.get(f.name)
        if f.name == "rules" and isinstance(v, list):
            names = {x.name for x in fields(RemovalRule)}
            known["rules"] = tuple(RemovalRule(**{k: x[k] for k in names & set(x)}) for x in v if isinstance(x, dict) and {"id", "kind", "text"} <= set(x))
        elif f.name == "remove_patterns" and isinstance(v, list):
            known[f.name] = tuple(x for x in v if isinstance(x, str))
        elif f.name == "replace_patterns" and isinstance(v, list):
            known[f.name] = tuple((x[0], x[1]) for x in v if isinstance(x, list | tuple) and len(x) == 2)
        elif isinstance(v, bool):
            known[f.name] = v
    return CleaningConfig(**known)


def read_config(path: str) -> CleaningConfig:
    """A ``.json`` file of at most 1 MiB."""
    _guard(path)
    if not os.path.isfile(path):
        raise ValueError("not a regular file")
    if os.path.getsize(path) > MAX_CONFIG_BYTES:
        raise ValueError("configuration file is too large")
    with open(path, encoding="utf-8") as f:
        return cleaning_from_json(f.read())


def write_config(path: str, config: CleaningConfig) -> None:
    _guard(path)
    text = to_json(config)
    if len(text.encode()) > MAX_CONFIG_BYTES:
        raise ValueError("configuration is too large")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _guard(path: str) -> None:
    if not path.lower().endswith(".json"):
        raise ValueError("configuration files end in .json")


@dataclass(frozen=True)
class ExportOptions:
    overwrite: bool = False
    timestamp: str = "1970-01-01T00:00:00Z"
    name_limit: int = 128
    source_roots: tuple[str, ...] = field(default_factory=tuple)
