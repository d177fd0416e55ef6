"""Settings of an index, by the part that reads them; variables ``GLEANERY_<NAME>`` override the defaults."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "GLEANERY_"


class SettingsError(ValueError):
    """A setting has no valid value."""


def _whole(least: int) -> Callable[[object], object]:
    def read(raw: object) -> int:
        value = int(raw)
        if value < least or isinstance(raw, bool):
            raise ValueError(f"must be a whole number of at least {least}")
        return value

    return read


def _weight(raw: object) -> float:
    value = float(raw)
    if not math.isfinite(value) or value < 0:
        raise ValueError("must be a finite number that isn't negative")
    return value


def _one_of(*names: str) -> Callable[[object], object]:
    def read(raw: object) -> str:
        value = str(raw).strip().lower()
        if value not in names:
            raise ValueError(f"must be one of {', '.join(names)}")
        return value

    return read


def _name(raw: object) -> str | None:
    return (str(raw).strip() or None) if raw is not None else None


def _folder(raw: object) -> Path:
    if not str(raw).strip():
        raise ValueError("must not be empty")
    return Path(str(raw).strip()).expanduser()


def _setting(default: object, read: Callable[[object], object]):
    return field(default=default, metadata={"read": read})


@dataclass(frozen=True)
class Settings:
    """Each field's reader turns a text or a value into a valid one, or tells what is wrong."""

    # Chunking.
    chunk_size_unit: str = _setting("characters", _one_of("characters", "tokens"))
    chunk_size: int = _setting(1000, _whole(1))
    chunk_overlap: int = _setting(150, _whole(0))
    # Embedding and reranking: a provider and its model go together.
    embedding_provider: str | None = _setting("sentence-transformers", _name)
    embedding_model: str | None = _setting("sentence-transformers/all-MiniLM-L6-v2", _name)
    embedding_model_version: str | None = _setting(None, _name)
    reranker_provider: str | None = _setting("sentence-transformers-cross-encoder", _name)
    reranker_model: str | None = _setting("cross-encoder/ms-marco-MiniLM-L-6-v2", _name)
    reranker_model_version: str | None = _setting(None, _name)
    reranker_top_k: int = _setting(5, _whole(1))
    # Retrieval and fusion.
    keyword_top_k: int = _setting(20, _whole(1))
    semantic_top_k: int = _setting(20, _whole(1))
    hybrid_top_k: int = _setting(10, _whole(1))
    hybrid_fusion_method: str = _setting("rrf", _one_of("rrf", "weighted_sum"))
    hybrid_keyword_weight: float = _setting(0.25, _weight)
    hybrid_semantic_weight: float = _setting(0.75, _weight)
    rrf_k: int = _setting(60, _whole(1))
    # Context of a hit.
    context_max_characters: int = _setting(4000, _whole(0))
    context_max_chunks: int = _setting(2, _whole(0))
    # Folders.
    store_dir: Path = _setting(Path("data/store"), _folder)
    corpus_dir: Path = _setting(Path("data/corpus"), _folder)

    def __post_init__(self) -> None:
        for item in fields(self):
            try:
                object.__setattr__(self, item.name, item.metadata["read"](getattr(self, item.name)))
            except (TypeError, ValueError) as error:
                raise SettingsError(f"{item.name} {error}") from error
        for holds, problem in (
            (self.chunk_overlap < self.chunk_size, "chunk_overlap must be below chunk_size"),
            (self.hybrid_keyword_weight + self.hybrid_semantic_weight > 0, "one fusion weight must be above zero"),
            (bool(self.embedding_provider) == bool(self.embedding_model), "embedding provider and model are set together or not at all"),
            (bool(self.reranker_provider) == bool(self.reranker_model), "reranker provider and model are set together or not at all"),
        ):
            if not holds:
                raise SettingsError(problem)

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] | None = None, project_root: str | Path = ".") -> Settings:
        """Settings with the variables' values; relative folders lie below ``project_root``."""
        known = os.environ if environ is None else environ
        given = {item.name: known[key] for item in fields(cls) if (key := PREFIX + item.name.upper()) in known}
        found, root = cls(**given), Path(project_root).expanduser().resolve()
        for name in ("store_dir", "corpus_dir"):
            object.__setattr__(found, name, root / getattr(found, name))
        return found
