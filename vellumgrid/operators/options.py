"""Options of the stages, one dataclass each; the defaults are the usual thresholds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LayoutOptions:
    input_size: int = 1024
    classes: int = 11
    least_score: float = 0.1
    merge_overlap: float = 0.45
    line_tolerance: float = 10.0
    background: int = 144


@dataclass(frozen=True)
class DetectOptions:
    input_size: int = 960
    least_region_score: float = 0.3
    binarize: float = 0.6
    least_side: float = 3.0
    padding: float = 6.0
    line_tolerance: float = 10.0
    merge_gap: float = 10.0


@dataclass(frozen=True)
class RecognizeOptions:
    input_height: int = 48
    least_token_score: float = 0.5
    rotate_above: float = 1.5


@dataclass(frozen=True)
class ParserOptions:
    clean_text: bool = True
    mode: str = "Auto"


class EngineError(Exception):
    """Something a whole request fails by: a missing backend, a bad file, a bad range."""


class BackendMissing(EngineError):
    """No renderer or model was given for a stage that needs one."""
