"""Settings. Environment variables override the defaults; blank ones do not count."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Names are those of the environment variables in lower case."""

    book_title: str = ""
    book_author: str = ""
    wiki_api: str = "https://bn.wikisource.org/w/api.php"
    wiki_host: str = "https://bn.wikisource.org"
    min_delay: float = 2.0
    max_retries: int = 6
    chunk_size: int = 800
    chunk_overlap: int = 150
    embedding_model: str = "hashing-64"
    embedding_device: str = "auto"
    embedding_batch: int = 16
    max_seq_length: int = 512
    top_k: int = 5
    semantic_k: int = 24
    final_k: int = 8
    context_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    weight_semantic: float = 0.58
    weight_lexical: float = 0.30
    weight_hint: float = 0.12
    missing_distance: float = 2.0
    qa_delay: float = 20.0
    #: Skip Unicode NFC on questions.
    strict_compat: bool = False


def env(name: str, default: str) -> str:
    """The variable, or the default where it is unset or blank."""
    value = (os.environ.get(name) or "").strip()
    return value or default


def from_environment(base: Config | None = None) -> Config:
    base = base or Config()
    found = {}
    for f in fields(Config):
        raw = env(f.name.upper(), "")
        if raw:
            kind = type(getattr(base, f.name))
            found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return replace(base, **found)
