"""Plain values that describe a comparison and its outcome."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnPair:
    """A source column and the target column that it is compared with."""

    source: str
    target: str
    source_type: T.DataType
    target_type: T.DataType


@dataclass(frozen=True)
class ParityOptions:
    trim: bool = False
    ignore_case: bool = False
    empty_as_null: bool = False
    tolerance: float = 0.0
    #: Keys of two numeric types meet as numbers; without it keys of different types meet as text.
    numeric_keys: bool = False


@dataclass(frozen=True)
class ParitySpec:
    """What to compare; without keys whole rows are compared as a multiset."""

    keys: tuple[ColumnPair, ...]
    compare: tuple[ColumnPair, ...]
    options: ParityOptions = ParityOptions()

    @property
    def mode(self) -> str:
        return "key" if self.keys else "rows"


@dataclass(frozen=True)
class KeyFigures:
    source_duplicates: int
    source_nulls: int
    target_duplicates: int
    target_nulls: int
    matched: int
    only_source: int
    only_target: int
    compared_rows: int


@dataclass
class ColumnOutcome:
    pair: ColumnPair
    mismatches: int = 0
    samples: list[dict] = field(default_factory=list)


@dataclass
class ParityResult:
    mode: str
    source_rows: int
    target_rows: int
    keys: KeyFigures | None
    row_sets: tuple[int, int] | None
    columns: list[ColumnOutcome]
    only_source_samples: list[list[str]]
    only_target_samples: list[list[str]]
    unpaired_source: list[str]
    unpaired_target: list[str]
    excluded: list[str]
    steps: list[str]
    engine_version: str
    elapsed_ms: float


@dataclass(frozen=True)
class Assessment:
    verdict: str
    findings: tuple[str, ...]
    gaps: tuple[str, ...]
