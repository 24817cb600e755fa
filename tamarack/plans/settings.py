"""Parameters of a run with their checks; unknown names are errors of the constructor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Chunking:
    most_chars: int = 1800
    overlap_chars: int = 220
    least_chars: int = 60
    preamble_chars: int = 1400


@dataclass(frozen=True)
class Retrieval:
    lexical_depth: int = 100
    dense_depth: int = 100
    fusion_constant: int = 60
    fused_depth: int = 50
    weights: dict[str, float] = field(default_factory=lambda: {"bm25": 1.0, "dense": 1.0})
    boost: float = 0.12
    rerank_depth: int = 50
    ks: tuple[int, int, int] = (3, 5, 8)


@dataclass(frozen=True)
class Evidence:
    most_chars: int = 12_000
    per_document: int = 3
    parent_chars: int = 5000
    least_ratio: float = 0.35


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    evidence: Evidence = Evidence()
    seed: int = 2026
    validation_size: int = 700
    labels_may_train: bool = False

    def __post_init__(self) -> None:
        c, r, e = self.chunking, self.retrieval, self.evidence
        rules = {
            "overlap below window": 0 <= c.overlap_chars < c.most_chars, "least chunk below window": 0 <= c.least_chars < c.most_chars, "ks positive and not falling": 0 < r.ks[0] <= r.ks[1] <= r.ks[2], "depths positive": min(r.lexical_depth, r.dense_depth, r.fused_depth, r.rerank_depth) > 0,
            "fusion constant positive": r.fusion_constant > 0, "weights not negative, one positive": min(r.weights.values(), default=0) >= 0 < max(r.weights.values(), default=0), "ratio within 0 and 1": 0 <= e.least_ratio <= 1, "budgets positive": min(e.most_chars, e.per_document, e.parent_chars) > 0,
            "validation size positive": self.validation_size > 0, "diagnostic labels never train": not self.labels_may_train,
        }
        if broken := [name for name, kept in rules.items() if not kept]:
            raise ValueError("; ".join(broken))


def settings_of(text: str) -> Settings:
    """Settings from a JSON object of sections; what is left out has its default."""
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("settings are an object")
    sections = {f.name: type(f.default) for f in fields(Settings) if f.name in ("chunking", "retrieval", "evidence")}
    made = {}
    for name, value in given.items():
        if name in sections:
            value = sections[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        made[name] = value
    return Settings(**made)
