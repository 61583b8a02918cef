"""Settings of the clock-stream operators; every limit is a field with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Seconds unless said otherwise; camera seconds are those of the recorded clock, the others of the position axis."""

    interval: int = 10
    frames_per_sample: int = 3
    mode: str = "daily"
    #: Camera seconds beyond the position's advance that make a jump, and those that make it large.
    least_gap: int = 60
    large_gap: int = 3600
    backward: int = -1800
    #: Reading cleaner.
    most_drift: int = 900
    most_run: int = 3
    wrap_minutes: int = 720
    #: Cuts.
    fuse_window: float = 5.0
    min_clip: float = 120.0
    artifact_clip: float = 3.0
    orphan_gap: float = 30.0
    dead_zone: float = 120.0
    #: Snap to scene cuts.
    snap_context: float = 20.0
    snap_accept: float = 0.5
    snap_burst_accept: float = 3.0
    snap_after: float = 2.0
    snap_burst_most: float = 6.0
    #: Key frames and cut plan.
    look_back: float = 30.0
    look_ahead: float = 30.0
    least_segment: float = 0.05
    #: Length of a tile of a long tape, and the duration from which a tape is worked on in tiles.
    tile_s: float = 36_000.0
    long_tape_s: float = 1_000_000.0
    #: Clock models: the fewest readings of a fit, and how far from it a reading may be.
    model_readings: int = 5
    model_residual_s: float = 300.0
    #: Years that a reading may have, and the first two-digit year of the 1900s.
    first_year: int = 1985
    last_year: int = 2005
    pivot: int = 80
    eval_pivot: int = 85
    #: Caches.
    crop: str = "560:130:40:350"
    cache_format: int = 5
    visual_cache_format: int = 1
    scene_threshold: float = 0.4
    black_min_duration: float = 0.1
    calibration_samples: int = 20
    #: Evaluator: distances within which a cut and a group of readings count as a boundary's.
    eval_cut_distance: float = 120.0
    eval_group_distance: float = 5.0
    #: How far before and behind a boundary its true change is searched.
    search_before: float = 60.0
    search_behind: float = 5.0

    def clip_floor(self) -> float:
        """The shortest clip of the mode."""
        return self.artifact_clip if self.mode == "daily" else self.min_clip


DEFAULTS = Settings()
