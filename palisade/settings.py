"""Settings of the decision engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    internal_keywords: tuple[str, ...] = ("TEST-ORION",)
    internal_domains: tuple[str, ...] = ("corp.example", "internal.example")
    max_prompt_chars: int = 16_000
    max_body_bytes: int = 70_000
    max_upload_bytes: int = 20 * 1024 * 1024
    rate_limit: int = 30
    rate_window_seconds: int = 60
    regex_timeout_seconds: float = 0.025
