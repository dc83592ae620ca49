"""Parameters of an alignment, with the defaults of the domain."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """``small_slope`` stays at its default when ``cost_contig`` changes; give it to change it.

    ``cost_contig`` and ``cost_optical`` are the costs of a missed site, ``sigma2`` is the variance for each base pair of the query, ``delta`` the
    most fragments in a block (one more in local mode), ``sd_min`` to ``sd_max`` the sizing tolerances tried in turn.  ``max_matches`` of 0
    gives none for a strand and all for a contig, less than 0 gives all.
    """

    circular: bool = False
    local: bool = False
    reverse: bool = True
    one_to_one: bool = False
    boundaries: bool = True
    p_threshold: float = 0.05
    sd_min: int = 4
    sd_max: int = 12
    cost_contig: float = 3.0
    cost_optical: float = 5.0
    max_miss_rate: float = 0.50
    min_length_ratio: float = 0.90
    max_avg_chi2: float = 10.0
    max_matches: int = 5
    min_hits: int = 5
    trials: int = 0
    sigma2: float = 100.0
    delta: int = 5
    small: int = 2000
    small_slope: float = 0.0015
    h: float = 5.0
    t: float = 2.0

    @property
    def t2(self) -> float:
        return self.t * self.t

    @property
    def a(self) -> float:
        return self.h / self.t2

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
