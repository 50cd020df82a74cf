"""Settings as immutable values that are passed explicitly."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

# Field names, types and thresholds that stored data and results depend on.
METADATA_FIELDS: tuple[tuple[str, str], ...] = (
    ("doc_id", "string"),
    ("source", "string"),
    ("filename", "string"),
    ("content_type", "string"),
    ("media_type", "string"),
    ("created_at", "string"),
    ("lang", "string"),
    ("text_len", "number"),
    ("tags", "array"),
    ("keyphrases", "array"),
    ("quality_score", "number"),
    ("chunk_index", "number"),
    ("chunk_type", "string"),
    ("chunk_size", "number"),
    ("total_chunks", "number"),
    ("page_number", "number"),
    ("start_time", "number"),
    ("end_time", "number"),
    ("caption_count", "number"),
    ("region_index", "number"),
)
FRACTIONS = frozenset({"quality_score", "start_time", "end_time"})
EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".doc", ".png", ".jpg", ".jpeg", ".webp", ".mp3", ".wav", ".mp4", ".mov", ".avi", ".mkv", ".csv", ".xls", ".xlsx")
MEDIA_TYPES = ("pdf", "document", "text", "image", "video", "audio")
MEDIA_KEYWORDS = {"文本,文档,text": "text", "图片,图像,image": "image", "视频,video": "video", "音频,audio": "audio", "pdf": "pdf"}
LANG_ALIASES = {"中文,简体中文,zh,zh_cn": "zh", "英文,english,en": "en"}
STOPWORDS = ("的", "和", "了", "the", "and")
CHUNK_TABLE = {"text": (800, 120), "pdf": (900, 180), "image": (300, 80), "video": (1000, 200), "audio": (1000, 200), "code": (400, 160)}


@dataclass(frozen=True)
class Quality:
    """Weights and bounds of the rule-based quality score."""

    min_len: int = 20
    sat_len: int = 200
    garbled: float = 0.4
    valid: float = 0.2
    length: float = 0.2
    ocr: float = 0.2


@dataclass(frozen=True)
class Chunking:
    """Chunk sizes and overlaps, in characters."""

    auto: bool = True
    default: tuple[int, int] = (800, 150)
    by_media: tuple[tuple[str, tuple[int, int]], ...] = tuple(CHUNK_TABLE.items())
    target: int = 512
    overlap_ratio: float = 0.15
    max_context: int = 8192


@dataclass(frozen=True)
class Retrieval:
    """Scoring, fusion and context settings."""

    metric: str = "cosine_distance"
    normalize: bool = True
    alpha: float = 1.0
    method: str = "rrf"
    rrf_k: int = 60
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    rerank_top_n: int = 10
    preview_items: int = 3
    context_items: int = 6
    max_tokens: int = 1500
    graph_hops: int = 1
    graph_limit: int = 10


@dataclass(frozen=True)
class Settings:
    """All settings of the engine."""

    metadata: tuple[tuple[str, str], ...] = METADATA_FIELDS
    default_lang: str = "zh"
    chinese_threshold: float = 0.3
    min_lang_chars: int = 10
    stopwords: tuple[str, ...] = STOPWORDS
    keyphrases: int = 10
    quality: Quality = field(default_factory=Quality)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings with the values that a JSON object gives; nested objects change nested values."""
        return _overlay(cls(), json.loads(text))


def _overlay(base: Any, changes: dict[str, Any]) -> Any:
    """``base`` with ``changes``; unknown names raise, nested objects merge."""
    out = {}
    for name, value in changes.items():
        now = getattr(base, name)
        if isinstance(value, dict):
            value = _overlay(now, value) if hasattr(now, "__dataclass_fields__") else tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in value.items())
        elif isinstance(value, list):
            value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
        out[name] = value
    return replace(base, **out)
