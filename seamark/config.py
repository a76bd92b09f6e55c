"""Settings, with the defaults, a file and the environment as sources."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import partial

from .functions.chunking import Sizes
from .functions.embedding import Embedder, HashEmbedder, HttpEmbedder
from .functions.paths import IGNORE
from .functions.text import CHUNK_BYTES
from .functions.vectors import METRICS


@dataclass(frozen=True)
class Config:
    small_max_tokens: int = 300
    medium_max_tokens: int = 200
    large_max_tokens: int = 150
    max_chunk_bytes: int = CHUNK_BYTES
    hierarchy: bool = True
    max_file_size_mb: float = 1
    max_results: int = 5
    semantic_weight: float = 0.7
    exact_match_boost: float = 1.5
    min_score_threshold: float | None = None
    #: hash (no model) or http (a model server at embedding_url).
    embedder: str = "hash"
    embedding_model: str = "nomic-embed-text"
    embedding_url: str = "http://localhost:11434"
    embed_batch: int = 16
    embed_in_flight: int = 10
    dimensions: int = 256
    full_dimension: int = 768
    use_mrl: bool = True
    normalize: bool = True
    metric: str = "cosine"
    ignore: tuple[str, ...] = IGNORE
    compat: bool = False

    def __post_init__(self):
        if min(self.max_results, self.embed_batch, self.embed_in_flight, self.dimensions, self.full_dimension) < 1:
            raise ValueError("max_results, embed_batch, embed_in_flight and the dimensions must be at least 1")
        if self.embedder not in ("hash", "http"):
            raise ValueError(f"unknown embedder: {self.embedder}")
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric: {self.metric}")

    def make_embedder(self) -> Callable[[], Embedder]:
        """What makes the embedder, on the driver and in each task."""
        if self.embedder == "hash":
            return partial(HashEmbedder, self.dimensions)
        return partial(HttpEmbedder, self.embedding_url, self.embedding_model, self.full_dimension, self.dimensions, self.use_mrl, self.normalize, in_flight=self.embed_in_flight)

    @property
    def sizes(self) -> Sizes:
        return Sizes(self.small_max_tokens, self.medium_max_tokens, self.large_max_tokens)


def load(path: str | None = None, env: dict | None = None) -> Config:
    """Defaults, then a JSON (or, with a YAML library, YAML) file, then OLLAMA_URL and EMBEDDING_MODEL, which choose the model server.

    Without a path: SEAMARK_CONFIG, ./config.yaml, ~/.seamark/config.yaml, the first that exists.
    """
    env = os.environ if env is None else env
    places = [path] if path else [env.get("SEAMARK_CONFIG"), "config.yaml", os.path.expanduser("~/.seamark/config.yaml")]
    c = Config()
    for p in places:
        if p and os.path.exists(os.path.expanduser(p)):
            with open(os.path.expanduser(p)) as f:
                c = merged(c, _parse(f.read(), p))
            break
    over = {k: v for k, v in (("embedding_url", env.get("OLLAMA_URL")), ("embedding_model", env.get("EMBEDDING_MODEL"))) if v}
    return replace(c, **over, **({"embedder": "http"} if over else {}))


def _parse(text: str, path: str) -> dict:
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs a YAML library; use JSON") from e
    return yaml.safe_load(text) or {}


def merged(c: Config, values: dict) -> Config:
    """Known names, flat or nested in sections."""
    known = {f.name for f in fields(Config)}
    flat: dict = {}
    for k, v in values.items():
        if isinstance(v, dict):
            flat |= {a: b for a, b in v.items() if a in known}
        elif k in known:
            flat[k] = v
    if "ignore" in flat:
        flat["ignore"] = tuple(flat["ignore"])
    return replace(c, **flat)
