"""Scan options and the filters they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

# Method bits.
EXACT, NAME, IMAGE, VIDEO = 1, 2, 4, 8
METHODS = {"ExactContent": EXACT, "NameSimilarity": NAME, "PerceptualImage": IMAGE, "PerceptualVideo": VIDEO}
#: Least share of frames that match for two videos to be linked.
FRAME_MATCH = 0.6


@dataclass(frozen=True)
class ScanOptions:
    """What to scan and which detectors to run; 0 bytes means no bound."""

    roots: tuple[str, ...] = ()
    methods: int = EXACT
    recursive: bool = True
    include_hidden: bool = False
    min_bytes: int = 0
    max_bytes: int = 0
    include_extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    excluded_folders: tuple[str, ...] = ()
    name_threshold: float = 0.85
    perceptual_threshold: int = 8
    video_samples: int = 12
    intro_skip: float = 0.08
    outro_skip: float = 0.05
    video_seed: int = 0
    analyze_quality: bool = False
    blur: float = 120.0
    dark: float = 42.0
    low_resolution: int = 500
    extra: dict = field(default_factory=dict, hash=False, compare=False)
