"""Immutable settings of the pipelines; every range is checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class GenomeConfig:
    """Two circular chromosomes on one integer axis; ids above `total` are genes."""

    # fixed values: lengths of the default genome
    chr1_len: int = 3_288_558
    total: int = 5_165_770

    def __post_init__(self) -> None:
        _need(0 < self.chr1_len < self.total, "0 < chr1_len < total is required")

    @property
    def chr2_len(self) -> int:
        return self.total - self.chr1_len


@dataclass(frozen=True)
class VpConfig:
    maf: float = 0.02
    min_mac: int = 5
    weight_model: str = "SCC"
    scc_threshold: float = 0.98
    hcc_threshold: float = 0.75
    threshold: float | str = 0.3
    k: float = 1
    ld_threshold: int = 5000
    ld_chr2: int = 17500
    clip_eps: float = 1e-9
    target_pairs: int = 5_000_000
    sample_pairs: int = 50_000
    safety: float = 0.60
    tile: int = 1024
    apply_gwes_filter: bool = True
    genome: GenomeConfig = field(default_factory=GenomeConfig)

    def __post_init__(self) -> None:
        _need(0 <= self.maf <= 0.5, "maf must lie in [0, 0.5]")
        _need(self.min_mac >= 0, "min_mac must not be negative")
        _need(self.weight_model in ("NW", "SCC", "HCC"), "weight_model is NW, SCC or HCC")
        _need(self.threshold == "auto" or 0 <= float(self.threshold) <= 1, "threshold is 'auto' or in [0, 1]")
        _need(0 < self.safety <= 1, "safety must lie in (0, 1]")
        _need(self.sample_pairs >= 1000, "sample_pairs must be at least 1000")
        _need(self.tile >= 1, "tile must be positive")


@dataclass(frozen=True)
class HighOrderConfig:
    method: str = "auto"
    bootstrap: int = 200
    sample_size: int = 100_000
    min_stability: float = 0.80
    k_upper: float = 1.0
    k_lower: float = 2.0
    min_abs: float = 0.15
    upper_q: float = 0.95
    lower_q: float = 0.05
    min_tail: int = 100
    min_rows: int = 1000
    bins: int = 128
    seed: int = 2026
    genome: GenomeConfig = field(default_factory=GenomeConfig)

    def __post_init__(self) -> None:
        _need(self.method in ("auto", "iqr", "quantile"), "method is auto, iqr or quantile")
        _need(self.bootstrap >= 20, "bootstrap must be at least 20")
        _need(self.sample_size >= 1000, "sample_size must be at least 1000")
        _need(0.5 <= self.min_stability < 1, "min_stability must lie in [0.5, 1)")
        _need(min(self.k_upper, self.k_lower) >= 0, "k must not be negative")
        _need(0.5 < self.upper_q < 1 and 0 < self.lower_q < 0.5, "tail quantiles are out of range")
        _need(self.min_tail >= 20, "min_tail must be at least 20")
