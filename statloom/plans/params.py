"""Parameters of the rating engine; every default can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The mapped components, with the fallback constants of the six value streams in turn.
COMPONENTS = ("a_f", "a_o", "n_f", "n_o", "r_f", "r_o")


@dataclass(frozen=True)
class Params:
    basis: float = 96.0
    components: tuple[str, ...] = COMPONENTS
    history: tuple[int, int] = (1995, 2000)
    final: int = 2000
    live: int = 2001
    signal: float = 0.003
    methodology: str = "1.0.0"
    min_matches: int = 3
    min_groups: int = 20
    k_range: tuple[float, float] = (5.0, 20000.0)
    min_split_half: float = 0.05
    fallback_k: dict[str, float] = field(default_factory=lambda: dict(zip(COMPONENTS, (250.0, 250.0, 150.0, 900.0, 1500.0, 5000.0))))
    volume_range: tuple[float, float] = (10.0, 50000.0)
    volume_fallback: dict[str, float] = field(default_factory=lambda: dict(zip(COMPONENTS, (900.0, 900.0, 900.0, 900.0, 600.0, 600.0))))
    min_exposure: float = 180.0
    min_opps: int = 5
    regular_exposure: float = 900.0
    drift_exposure: float = 450.0
    drift_floor: float = 0.15
    drift_fallback: float = 0.50
    final_bars: tuple[float, float] = (2200.0, 1800.0)
    live_shares: tuple[float, float] = (0.75, 0.60)
    live_floors: tuple[float, float] = (270.0, 90.0)
    min_pool: int = 12
    resamples: int = 2000
    seed: int = 20260101
    interval: float = 0.90
    bands: tuple[float, float, float, float] = (85.0, 70.0, 30.0, 15.0)
    min_claim_opps: int = 25


DEFAULT = Params()
