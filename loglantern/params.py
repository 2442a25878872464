"""Job parameters with the bounds every job checks before it starts."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86400

# The limits below are the accepted parameter ranges.
LIMITS = {
    "capture_time": (0, 7 * DAY),
    "capture_time_max": (0, 30 * DAY),
    "line_count_max": (0, None),
    "context_bytes": (1, None),
    "purge_interval": (0, 30 * DAY),
    "resume_max": (0, 30 * DAY),
    "compact_after_months": (0, None),
    "delete_after_months": (0, None),
    "excerpt_bytes": (0, None),
    "priority": (1, 5),
}


def check(**values) -> None:
    """Raise ValueError for the first value outside its range."""
    for name, value in values.items():
        low, high = LIMITS[name]
        if value < low or (high is not None and value > high):
            span = f"at least {low}" if high is None else f"{low} to {high}"
            raise ValueError(f"{name} must be {span}: {value}")


@dataclass(frozen=True)
class CaptureParams:
    """Seconds a match keeps a capture open, its longest duration (0: none), the
    lines allowed after the opening match, and the bytes of look-back context."""

    capture_time: int = 300
    capture_time_max: int = 3600
    line_count_max: int = 10000
    context_bytes: int = 16 * 1024 * 1024

    def __post_init__(self):
        check(
            capture_time=self.capture_time,
            capture_time_max=self.capture_time_max,
            line_count_max=self.line_count_max,
            context_bytes=self.context_bytes,
        )

    @property
    def window_us(self) -> int:
        return self.capture_time * 1_000_000

    @property
    def longest_us(self) -> int:
        return self.capture_time_max * 1_000_000

    @property
    def reach(self) -> int:
        """Line numbers a capture can span beyond its opener."""
        return self.line_count_max + 1


@dataclass(frozen=True)
class RequestParams:
    """What turns captures into requests: which channels are on, and their limits."""

    notify: bool = True
    events: bool = False
    model: bool = False
    model_name: str = "model"
    notes: str = ""
    excerpt_bytes: int = 32768
    priority: int = 3
    source: str = "loglantern"
    version: str = "1"

    def __post_init__(self):
        check(excerpt_bytes=self.excerpt_bytes, priority=self.priority)
