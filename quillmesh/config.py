"""Where tables of a deployment lie, and the numbers of a search. Paths follow the root, wherever it is moved."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quillmesh.operators import bm25, graph, ranking
from quillmesh.operators import fusion as fusing


@dataclass(frozen=True)
class Settings:
    root: str = "quillmesh-data"
    encoders: tuple[str, ...] = ("hash_a", "hash_b", "hash_c")
    top_k: int = ranking.TOP_K
    fusion: str = "rrf"
    rrf_k0: int = fusing.RRF_K0
    n_documents: int = ranking.N_DOCUMENTS
    n_fragments: int = ranking.N_FRAGMENTS
    per_doc: int = ranking.MAX_PER_DOC
    expand_words: int | None = ranking.EXPAND_WORDS
    class_boost: float = ranking.CLASS_BOOST
    tail_weight: float = 0.0
    tail_n: int = 0
    copy_cosine: float = ranking.COPY_COSINE
    translation_cosine: float = ranking.TRANSLATION_COSINE
    graph_weight: float = 0.5
    graph_rows: int = graph.TOP_ROWS
    lexical_rows: int = bm25.CANDIDATES
    extra: dict = field(default_factory=dict)

    def at(self, root: str) -> Settings:
        return replace(self, root=root.rstrip("/"))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"
