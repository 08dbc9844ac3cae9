"""Parameters of the scoring engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Risk by merchant category code; any other code has the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50


@dataclass(frozen=True)
class Limits:
    """What each raw quantity is divided by."""

    amount: float = 10000
    installments: float = 12
    amount_ratio: float = 10
    minutes: float = 1440
    km: float = 1000
    tx_count_24h: float = 20
    merchant_avg: float = 10000


@dataclass(frozen=True)
class Scoring:
    limits: Limits = field(default_factory=Limits)
    k: int = 5
    declined_from: int = 3
    most_request_bytes: int = 8192


@dataclass(frozen=True)
class Ivf:
    """nprobe and k beyond 32 count as 32. Fixed value: the seed."""

    centroids: int = 16
    nprobe: int = 3
    k: int = 5
    iterations: int = 5
    seed: int = 0x517CC1B727220A95


DIMENSIONS = 14
V = [f"v{i}" for i in range(DIMENSIONS)]
Q = [f"q{i}" for i in range(DIMENSIONS)]
U = [f"u{i}" for i in range(DIMENSIONS)]
