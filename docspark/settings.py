"""Settings from the environment, read when they are asked for."""

from __future__ import annotations

import os
from dataclasses import dataclass

# The models asked where none are named.
DEFAULT_MODELS = ("openai:gpt-4o-mini", "gemini:gemini-3-flash-preview", "deepseek:deepseek-chat")


def csv(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


@dataclass(frozen=True)
class Settings:
    """Chunk sizes, folders, addresses and models; every field has a default."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    max_pages: int = 30
    cache_dir: str = "cache"
    base_url: str = "http://127.0.0.1:8001"
    models: tuple[str, ...] = DEFAULT_MODELS
    judge_model: str = ""
    language: str = "en"

    @property
    def default_model(self) -> str:
        return self.models[0]

    @staticmethod
    def from_env(prefix: str = "DOCSPARK_") -> Settings:
        get = lambda name, default: os.environ.get(prefix + name) or default
        d = Settings()
        return Settings(
            int(get("MAX_TOKENS", d.max_tokens)),
            int(get("OVERLAP_TOKENS", d.overlap_tokens)),
            min(60, max(1, int(get("MAX_PAGES", d.max_pages)))),
            get("CACHE_DIR", d.cache_dir),
            get("BASE_URL", d.base_url).rstrip("/"),
            tuple(csv(get("MODELS", ""))) or d.models,
            get("JUDGE_MODEL", d.judge_model),
            get("LANGUAGE", d.language),
        )
