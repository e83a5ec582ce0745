"""Configuration: defaults, ranges, and a JSON loader that names everything that is wrong."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Rule:
    """What a setting must be: kind, range or choices."""

    kind: type | tuple[type, ...]
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    length: int = 0

    def problems(self, name: str, value: Any) -> list[str]:
        if isinstance(value, bool) and self.kind is not bool or not isinstance(value, self.kind):
            return [f"{name}: {value!r} has the wrong type"]
        if self.low is not None and value < self.low:
            return [f"{name}: {value!r} is less than the minimum of {self.low}"]
        if self.high is not None and value > self.high:
            return [f"{name}: {value!r} is greater than the maximum of {self.high}"]
        if self.choices and value not in self.choices:
            return [f"{name}: {value!r} is not one of {list(self.choices)}"]
        if self.length and len(value) < self.length:
            return [f"{name}: {value!r} is too short"]
        return []


NUMBER, TEXT, YES_NO = (int, float), Rule(str, length=1), Rule(bool)


@dataclass
class SearchConfig:
    base_url: str = "https://api.inaturalist.org"
    timeout: float = 30
    rate_limit: float = 1.0
    burst_limit: int = 5
    max_retries: int = 3
    cache_enabled: bool = True
    cache_path: str = "cache/responses"
    cache_ttl_days: int = 7


@dataclass
class LlmConfig:
    provider: str = ""
    model: str = ""
    enabled: bool = True
    url: str | None = None
    timeout: float = 60
    prompt_file: str = "prompts/llm_extractor.txt"
    chunk_strategy: str = "paragraph"
    min_chunk_words: int = 50
    max_chunk_words: int = 500
    auto_start: bool = False
    auto_pull_model: bool = False
    stop_after_run: bool = False


@dataclass
class Config:
    confidence: float
    locale: str
    gazetteer_path: str = "data/gazetteer"
    spacy_model: str = "ru_core_news_md"  # read for compatibility; segmentation is by rule
    max_file_size_mb: float = 2.0
    degraded_mode: bool = False
    user_agent: str = "binomia/0.1"
    inaturalist: SearchConfig = field(default_factory=SearchConfig)
    llm_extractor: LlmConfig | None = None
    llm_enricher: LlmConfig | None = None


# The ranges that settings must keep to.
ROOT = {
    "confidence": Rule(NUMBER, 0, 1), "locale": Rule(str, length=2), "gazetteer_path": TEXT, "spacy_model": TEXT, "max_file_size_mb": Rule(NUMBER, 0.1, 100),
    "degraded_mode": YES_NO, "user_agent": TEXT, "inaturalist": Rule(dict), "llm_extractor": Rule((dict, type(None))), "llm_enricher": Rule((dict, type(None))),
}
SEARCH = {
    "base_url": TEXT, "timeout": Rule(NUMBER, 1, 120), "rate_limit": Rule(NUMBER, 0.1, 10), "burst_limit": Rule(int, 1, 20), "max_retries": Rule(int, 0, 10),
    "cache_enabled": YES_NO, "cache_path": TEXT, "cache_ttl_days": Rule(int, 1, 365),
}
ENRICHER = {
    "enabled": YES_NO, "provider": Rule(str, choices=("ollama", "openai", "anthropic")), "model": TEXT, "url": TEXT, "timeout": Rule(NUMBER, 1, 300), "prompt_file": TEXT,
    "auto_start": YES_NO, "auto_pull_model": YES_NO, "stop_after_run": YES_NO,
}
EXTRACTOR = ENRICHER | {"timeout": Rule(NUMBER, 1, 600), "chunk_strategy": Rule(str, choices=("paragraph", "page")), "min_chunk_words": Rule(int, 10, 500), "max_chunk_words": Rule(int, 100, 2000)}


def _problems(data: dict, rules: dict[str, Rule], required: tuple[str, ...], prefix: str = "") -> list[str]:
    out = [f"{prefix}{k} is a required property" for k in required if k not in data]
    out += [f"{prefix}{k} was unexpected" for k in data if k not in rules]
    return out + [p for k, v in data.items() if k in rules for p in rules[k].problems(prefix + k, v)]


def parse_config(data: dict) -> Config:
    found = _problems(data, ROOT, ("confidence", "locale"))
    for name, rules, required in (("inaturalist", SEARCH, ()), ("llm_extractor", EXTRACTOR, ("provider", "model")), ("llm_enricher", ENRICHER, ("provider", "model"))):
        if isinstance(data.get(name), dict):
            found += _problems(data[name], rules, required, f"{name}.")
    if found:
        raise ValueError("Invalid config: " + "; ".join(found))
    own = {f.name: data[f.name] for f in fields(Config) if f.name in data}
    own["inaturalist"] = SearchConfig(**data.get("inaturalist") or {})
    for name, default in (("llm_extractor", {}), ("llm_enricher", {"prompt_file": "prompts/llm_enricher.txt", "timeout": 30})):
        own[name] = LlmConfig(**default | data[name]) if data.get(name) else None
    return Config(**own)


def load_config(path: str | Path) -> Config:
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"Config file not found: {path}")
    return parse_config(json.loads(path.read_text(encoding="utf-8")))
