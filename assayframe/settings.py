"""Settings of a run: defaults, each of which an environment variable of the same name may override."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "ASSAYFRAME_"


@dataclass(frozen=True)
class Settings:
    report_chars: int = 6000
    context_chars: int = 3500
    context_passages: int = 10
    retrieval_mode: str = "hybrid"  # hybrid, dense or bm25
    use_reranker: bool = False
    verify_rewrite: bool = False
    max_rewrites: int = 1
    rules: bool = True
    least_scan_chars: int = 50
    chunk_size: int = 500
    chunk_overlap: int = 80
    tags_a_category: int = 4
    inferred_share: float = 0.25
    model: str = ""
    embed_model: str = ""
    reranker_model: str = ""
    cache_dir: str = ""
    catalogue_path: str = ""
    articles_path: str = ""
    salt: str = ""

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        """Defaults with what the environment says; "0", "false" and "no" are false."""
        env = os.environ if env is None else env
        got = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                got[f.name] = raw.strip().lower() not in ("", "0", "false", "no") if kind is bool else kind(raw)
        return cls(**got)
