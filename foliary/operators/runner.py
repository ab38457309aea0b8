"""Asking a provider for proposals, one packet at a time, with retries; failures are rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.schemas import ROLE_SCOPES, ROLES

#: HTTP statuses after which another attempt may succeed, besides all from 500 on.
RETRYABLE = (408, 429)
PROPOSAL = "packet_id string, target string, text_sha256 string, role string, scope string, confidence double, abstained boolean, evidence_ids array<string>, rationale string, input_tokens long, output_tokens long, total_tokens long, cost double"
SCHEMA = f"{PROPOSAL}, ok boolean, code string, message string, attempts int, elapsed_ms long"


class ProviderError(Exception):
    """A call that failed; another attempt may help if it is retryable."""

    def __init__(self, code: str, message: str = "", retryable: bool = False):
        super().__init__(message)
        self.code, self.message, self.retryable = code, message, retryable


class Provider(Protocol):
    """What a task asks: a packet (a dict) in, a proposal (a dict of PROPOSAL's columns) out, or a ProviderError."""

    def review(self, packet: dict) -> dict: ...


def http_error(status: int | None, text: str = "") -> ProviderError:
    """The error for an HTTP status, or for none at all."""
    if status is None:
        return ProviderError("provider_unreachable", text, True)
    code = {401: "provider_unauthorized", 403: "provider_unauthorized", 408: "provider_timeout", 429: "provider_rate_limited"}.get(status, "provider_server_error" if status >= 500 else "provider_rejected")
    return ProviderError(code, text, status in RETRYABLE or status >= 500)


def cost(input_tokens: int | None, output_tokens: int | None, per_million_in: float | None, per_million_out: float | None) -> float | None:
    """What a call costs, or null if a price is not known."""
    if per_million_in is None or per_million_out is None:
        return None
    return ((input_tokens or 0) * per_million_in + (output_tokens or 0) * per_million_out) / 1_000_000


def parsed(text: str) -> dict:
    """A proposal from a model's answer: one JSON object with known roles and scopes; ProviderError if it is none."""
    try:
        made = json.loads(text)
    except ValueError as e:
        raise ProviderError("invalid_model_output", str(e)) from e
    if not isinstance(made, dict) or (made.get("role") is not None and made["role"] not in ROLES) or (made.get("scope") is not None and not any(made["scope"] in s for s in ROLE_SCOPES.values())):
        raise ProviderError("invalid_model_output", "not a proposal")
    if not isinstance(made.get("confidence"), (int, float)) or not 0 <= made["confidence"] <= 1:
        raise ProviderError("invalid_model_output", "confidence is not between 0 and 1")
    return made


def run(packets: DataFrame, make: Callable[[], Provider], max_retries: int = 1) -> DataFrame:
    """A row per packet: the provider's proposal, or the code of its failure, with attempts and time.

    ``make`` builds a provider in each task. A repeated task asks again, so write the result before using it twice.
    """
    if not 0 <= max_retries <= 3:
        raise ValueError("max_retries must be between 0 and 3")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            out = []
            for packet in pdf.to_dict("records"):
                start, attempts, row = time.perf_counter(), 0, {}
                while True:
                    attempts += 1
                    try:
                        row = {**provider.review(packet), "ok": True}
                    except ProviderError as e:
                        if e.retryable and attempts <= max_retries:
                            continue
                        row = {"ok": False, "code": e.code, "message": e.message}
                    break
                row |= {"packet_id": packet["packet_id"], "target": packet.get("target"), "attempts": attempts, "elapsed_ms": round((time.perf_counter() - start) * 1000)}
                out.append([row.get(n) for n in names])
            yield pd.DataFrame(out, columns=names).astype({n: object for n in names})

    return packets.mapInPandas(ask, SCHEMA)


def gates(artefacts: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``violation`` to artefacts (key, kind, input_sha256, content_fingerprint, mode): what no longer fits what it was made of.

    ``expected``: key, input_sha256, content_fingerprint, mode.
    """
    want = expected.select(key, *[F.col(c).alias(f"_{c}") for c in ("input_sha256", "content_fingerprint", "mode")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    stale = lambda what: F.concat(F.lit("stale_"), "kind", F.lit(f"_{what}"))
    code = F.when(F.col("_input_sha256").isNull(), "unknown_input").when(differs("input_sha256"), stale("input")).when(differs("content_fingerprint"), stale("fingerprint")).when(differs("mode"), stale("mode"))
    return artefacts.join(want, key, "left").withColumn("violation", code).select(*artefacts.columns, "violation")
