"""Editorial scope: weighted keyword lists plus scoring weights.

A scope is a driver-side parameter. Its term lists are folded into literal
regular expressions (one ``rlike`` per term) by ``curata.functions.keywords``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping


@dataclass(frozen=True)
class Weights:
    strong_keyword: float = 3.0
    normal_keyword: float = 1.0
    announcement_signal: float = 2.0
    exclude_penalty: float = 4.0
    source_weight_scale: float = 1.0
    min_score: float = 3.0

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> "Weights":
        d = d or {}
        known = {k: float(v) for k, v in d.items() if k in cls.__dataclass_fields__}
        return cls(**known)  # unknown keys are ignored


def _lc(terms) -> tuple[str, ...]:
    return tuple(str(t).lower() for t in (terms or ()))


@dataclass(frozen=True)
class Scope:
    name: str
    strong: tuple[str, ...] = ()
    normal: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    weights: Weights = field(default_factory=Weights)
    description: str = ""
    topics: tuple[str, ...] = ()

    def __post_init__(self):
        # term lists are compared lower-cased, in the order given
        for f in ("strong", "normal", "signals", "exclude", "topics"):
            vals = getattr(self, f)
            object.__setattr__(self, f, _lc(vals) if f != "topics" else tuple(vals or ()))

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> "Scope":
        if not d.get("name"):
            raise ValueError("scope config requires a 'name'")
        return cls(
            name=str(d["name"]),
            strong=d.get("strong_keywords", ()) or (),
            normal=d.get("normal_keywords", ()) or (),
            signals=d.get("announcement_signals", ()) or (),
            exclude=d.get("exclude_keywords", ()) or (),
            weights=Weights.from_dict(d.get("scoring")),
            description=str(d.get("description", "") or ""),
            topics=tuple(d.get("topics", ()) or ()),
        )


# --- fixed values: the shipped editorial scope (terms and weights as published) ---
SHIPPED_SCOPE = Scope(
    name="Practical AI: Tools, Models & Frameworks",
    strong=("large language model", "llm", "foundation model", "open source model",
            "open-weight", "open weights", "multimodal", "fine-tune", "fine-tuning",
            "inference", "model release", "new model", "framework", "sdk", "api",
            "developer tool", "agent framework", "context window", "benchmark",
            "diffusion model", "transformer", "quantization"),
    normal=("ai", "artificial intelligence", "machine learning", "neural network", "model",
            "tool", "feature", "library", "platform", "training", "dataset", "embedding",
            "vector", "gpu", "open source"),
    signals=("launches", "launched", "introducing", "introduces", "announces", "announced",
             "releases", "released", "now available", "unveils", "unveiled", "debuts",
             "rolls out", "rolling out", "general availability", "open sources",
             "open-sourced", "ships", "adds support"),
    exclude=("opinion", "op-ed", "podcast", "webinar", "hot take", "explainer", "how ai will",
             "the future of ai", "what to expect", "predictions for",
             "things you need to know", "top 10", "top ten", "listicle", "hiring",
             "job opening", "we're hiring", "sponsored", "advertisement", "horoscope",
             "opinion piece"),
    weights=Weights(3.0, 1.0, 2.0, 4.0, 1.0, 4.0),
)

# The driver tables hold invented prose, on which the shipped scope never fires.
# This scope uses frequent letter groups of that prose instead (test design).
TEST_SCOPE = Scope(
    name="Synthetic prose desk",
    strong=("tion", "thre", "of the", "thon"),
    normal=("that", "with", "ai", "from"),
    signals=("released", "ther", "thing", "was"),
    exclude=("que", "und", "los", "ist"),
    weights=Weights(3.0, 1.0, 2.0, 4.0, 1.0, 4.0),
)

# A second scope over the same tables, to show retargeting.
RETARGET_SCOPE = Scope(
    name="Continental desk",
    strong=("les", "der", "para"),
    normal=("und", "que", "the"),
    signals=("est", "ist", "es"),
    exclude=("tion", "ing"),
    weights=Weights(2.0, 0.5, 1.5, 3.0, 2.0, 3.0),
)
