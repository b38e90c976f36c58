"""Settings of the storage model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Sizes of the layered store that the layout operators describe.

    ``first_width`` tables make level 0 full (never more than ``level0_most``); each
    further level is ``factor`` times as wide.
    """

    memtable_entries: int = 1000
    factor: float = 1.618
    first_width: int = 2
    level0_most: int = 4
    block_bytes: int = 4096
    restart_interval: int = 16
    flush_fpr: float = 0.016
    bits_per_entry: int = 10
    least_fpr: float = 0.001
    most_fpr: float = 0.999

    def __post_init__(self) -> None:
        if self.factor < 1:
            raise ValueError("factor must be at least 1: levels must not shrink")
        for name in ("flush_fpr", "least_fpr", "most_fpr"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        for name in ("memtable_entries", "first_width", "level0_most", "block_bytes", "restart_interval", "bits_per_entry"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    def widths(self, levels: int) -> list[int]:
        """Tables that fill each level."""
        out = [self.first_width]
        while len(out) < levels:
            out.append(int(out[-1] * self.factor))
        return [min(out[0], self.level0_most), *out[1:]][:levels]

    def flushes_per_table(self, levels: int) -> list[int]:
        """Flushes that one table of each level holds: the radix products of the widths."""
        out = [1]
        for width in self.widths(levels):
            out.append(out[-1] * width)
        return out[: levels + 1]


DEFAULT = Config()

#: The value that stands for a deletion.
TOMBSTONE = "d34db33f"
