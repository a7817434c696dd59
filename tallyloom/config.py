"""Settings that are part of the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    amount_scale: int = 100
    default_currency: str = "INR"
    window_hours: int = 48
    settlement_days: int = 7
    amount_tolerance: int = 100
    fee_tolerance: int = 50
    fee_bps: int = 200
    amount_bucket: int = 10_000

    @property
    def window_sec(self) -> int:
        return self.window_hours * 3600

    @property
    def settlement_sec(self) -> int:
        return self.settlement_days * 86_400


CONFIG = EngineConfig()
