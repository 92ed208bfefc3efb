"""Options of an analysis and what a report says about its run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """k: tokens of a k-gram; window: k-grams that winnowing keeps one of; top_n 0: all; indexed: only pairs that share ``min_shared`` fingerprints."""

    k: int = 5
    window: int = 4
    threshold: float = 0.0
    top_n: int = 0
    normalize: bool = True
    indexed: bool = False
    min_shared: int = 1
    lexer: str = "cpp"

    def __post_init__(self) -> None:
        if self.k <= 0 or self.window <= 0:
            raise ValueError("k and window must be positive")
        if not 0 <= self.threshold <= 100:
            raise ValueError("threshold must be within 0 and 100")

    def using(self, lexer: str) -> Options:
        return replace(self, lexer=lexer)


@dataclass(frozen=True)
class RunInfo:
    root: str = ""
    timestamp: str = ""
    duration_ms: float = 0.0
    threads: int = 0
