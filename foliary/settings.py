"""Settings from the environment, each within its bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "FOLIARY_"
MODES = ("off", "prompt_only", "ambiguous_only")


@dataclass(frozen=True)
class Settings:
    """``FOLIARY_<NAME>`` overrides a default; an empty variable counts as unset."""

    data_dir: str = ".foliary"
    model_mode: str = "off"
    model: str | None = None
    model_key: str | None = None
    timeout_seconds: float = 30.0
    max_output_tokens: int = 500
    max_retries: int = 1
    input_cost_per_million: float | None = None
    output_cost_per_million: float | None = None

    def __post_init__(self) -> None:
        inside = {
            "model_mode": self.model_mode in MODES, "timeout_seconds": 0 < self.timeout_seconds <= 120, "max_output_tokens": 100 <= self.max_output_tokens <= 2000, "max_retries": 0 <= self.max_retries <= 3,
            **{c: getattr(self, c) is None or getattr(self, c) >= 0 for c in ("input_cost_per_million", "output_cost_per_million")},
        }
        wrong = sorted(name for name, fits in inside.items() if not fits)
        if wrong:
            raise ValueError(f"invalid_settings: {', '.join(wrong)}")

    def __repr__(self) -> str:
        return f"Settings({', '.join(f'{f.name}={getattr(self, f.name)!r}' for f in fields(self) if f.name != 'model_key')})"


def load(environment: Mapping[str, str] | None = None) -> Settings:
    given = os.environ if environment is None else environment
    kinds = {"timeout_seconds": float, "max_output_tokens": int, "max_retries": int, "input_cost_per_million": float, "output_cost_per_million": float}
    found = {}
    for f in fields(Settings):
        text = given.get(PREFIX + f.name.upper(), "")
        if text:
            try:
                found[f.name] = kinds.get(f.name, str)(text)
            except ValueError as e:
                raise ValueError(f"invalid_settings: {f.name}") from e
    return Settings(**found)


def model_gate(settings: Settings, plan_mode: str, confirmed: bool) -> None:
    """Whether a plan may be sent to a model: ValueError with a code if not."""
    if settings.model_mode == "off":
        raise ValueError("ai_disabled")
    if plan_mode != ("hybrid" if settings.model_mode == "ambiguous_only" else "prompt_only"):
        raise ValueError("ai_mode_mismatch")
    if not settings.model_key or not settings.model:
        raise ValueError("ai_not_configured")
    if not confirmed:
        raise ValueError("cloud_send_not_confirmed")
