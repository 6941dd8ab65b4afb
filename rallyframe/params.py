"""Parameters of all operators, with the values of the shipped configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    pose_confidence: float = 0.5  #: strictly above
    racket_confidence: float = 0.4  #: at least
    racket_class: int = 38
    racket_lost_frames: int = 5  #: lost beyond
    ball_radius_px: float = 10.0
    two_hand_wrist_px: float = 50.0  #: strictly under
    dominant_hand: str = "right"
    min_ball_radius: int = 3
    max_ball_radius: int = 15
    min_ball_movement: float = 8.0  #: strictly under is still
    x1: int = 650
    y1: int = 410
    x2: int = 1420
    y2: int = 980
    match_distance: float = 25.0
    static_movement: float = 5.0
    static_frames: int = 8
    max_lost_frames: int = 5
    history: int = 40
    trail: int = 8
    checkpoint_frames: int = 30
    outlier_sigma: float = 3.0
    width: int = 1920
    height: int = 1080
    detector_width: int = 640
    detector_height: int = 360
    box_pad: int = 20
    chunk_frames: int = 10_000  #: frames of a video that go together
    halo_frames: int = 16  #: frames before them that their bounded look-backs need

    def __post_init__(self):
        if self.min_ball_radius > self.max_ball_radius:
            raise ValueError("min_ball_radius is over max_ball_radius")
        if self.history < 1 or self.trail < 1 or self.checkpoint_frames < 1:
            raise ValueError("history, trail and checkpoint_frames must be at least 1")
        if not self.look_back <= self.halo_frames < self.chunk_frames:
            raise ValueError("halo_frames must cover look_back and be less than chunk_frames")

    @property
    def look_back(self) -> int:
        """Frames before one that its racket state can depend on: a carried event, the racket that it saw carried, its ball's frame before."""
        return 2 * self.racket_lost_frames + 1  # ``halo_frames`` leaves five more for what looks back on states


DEFAULT = Params()
