"""Settings, with their defaults; they go to JSON and back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from enum import Enum

from .errors import ConfigError


class Strategy(str, Enum):
    CHARACTER = "character"
    SENTENCE = "sentence"
    PARAGRAPH = "paragraph"
    TOKEN = "token"


class Metric(str, Enum):
    COSINE = "cosine"
    L2 = "l2"
    L1 = "l1"
    DOT = "dot"


class ErrorCorrection(str, Enum):
    L = "L"
    M = "M"
    Q = "Q"
    H = "H"


@dataclass(frozen=True)
class ChunkSettings:
    """Sizes are in bytes, for the character strategy in characters."""

    size: int = 1024
    overlap: int = 32
    min_size: int = 100
    strategy: Strategy = Strategy.SENTENCE

    def __post_init__(self):
        if self.size < 1 or self.overlap < 0 or self.min_size < 0:
            raise ConfigError("size must be positive, overlap and min_size not negative")


@dataclass(frozen=True)
class CodecSettings:
    compress: bool = True
    threshold: int = 100
    level: int = 6
    error_correction: ErrorCorrection = ErrorCorrection.M


@dataclass(frozen=True)
class EmbedSettings:
    dimension: int = 384
    max_tokens: int = 384
    normalize: bool = True
    lowercase: bool = False


@dataclass(frozen=True)
class SearchSettings:
    """candidate_factor: search the first factor * k rows by id only; None: all rows."""

    metric: Metric = Metric.COSINE
    max_results: int = 100
    min_score: float = 0.0
    candidate_factor: int | None = None


@dataclass(frozen=True)
class ContextSettings:
    before: int = 2
    after: int = 2
    adjacent_frames: bool = True
    max_total: int = 10
    min_importance: float | None = None


@dataclass(frozen=True)
class Settings:
    chunk: ChunkSettings = field(default_factory=ChunkSettings)
    codec: CodecSettings = field(default_factory=CodecSettings)
    embed: EmbedSettings = field(default_factory=EmbedSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    context: ContextSettings = field(default_factory=ContextSettings)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return _build(cls, json.loads(text))


_PARTS = {"chunk": ChunkSettings, "codec": CodecSettings, "embed": EmbedSettings, "search": SearchSettings, "context": ContextSettings}
_ENUMS = {"strategy": Strategy, "metric": Metric, "error_correction": ErrorCorrection}


def _build(kind: type, values: dict):
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    made = {}
    for name, value in values.items():
        part = _PARTS.get(name) if kind is Settings else None
        made[name] = _build(part, value) if part and is_dataclass(part) else _ENUMS[name](value) if name in _ENUMS else value
    return kind(**made)
