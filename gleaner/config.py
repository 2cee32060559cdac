"""Parameters of the engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class ChunkParams:
    ctx: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.ctx:
            raise ValueError("overlap must be below ctx")


@dataclass(frozen=True)
class ModelSpec:
    """An embedding model: its id, the most tokens it takes, and the length of its vectors."""

    model_id: str
    max_tokens: int
    dims: int


@dataclass(frozen=True)
class Config:
    bm25: BM25Params = field(default_factory=BM25Params)
    chunk: ChunkParams = field(default_factory=ChunkParams)
    min_score: float | None = None
    depth: int = 1
    models: dict[str, ModelSpec] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.depth < 1:
            raise ValueError("depth must be above 0")

    def path(self, root: str, name: str) -> str:
        """Where an artefact of this depth lies."""
        return f"{root}/depth_{self.depth}/{name}"

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def parse(text: str) -> Config:
        raw = json.loads(text)
        return Config(BM25Params(**raw.get("bm25", {})), ChunkParams(**raw.get("chunk", {})), raw.get("min_score"), raw.get("depth", 1), {k: ModelSpec(**v) for k, v in raw.get("models", {}).items()})

    def at_depth(self, depth: int) -> Config:
        return replace(self, depth=depth)


#: How many results a search gives, and gives at most.
DEFAULT_RESULTS = 50
MOST_RESULTS = 10_000


def check_results(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("the number of results must be an integer above 0")
    return k
