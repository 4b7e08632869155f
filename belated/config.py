"""Default parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    first_year: int = 1980
    last_year: int = 1989
    cutoffs: tuple[float, ...] = (3.5, 7.5, 11.5)
    train_years: tuple[int, int] = (1982, 1986)
    val_year: int = 1987
    test_years: tuple[int, int] = (1988, 1989)
    tails: tuple[float, ...] = (0.001, 0.005, 0.010)
    gamma: float = 1.0
    costs: dict[float, float] = field(default_factory=lambda: {3.5: 1.0, 7.5: 1.88, 11.5: 3.85})
    reward: float = 8.0
    positive_weight: float = 300.0
    min_class: int = 10
    label_age: int = 25
    feature_age: int = 20

    @property
    def total_cost(self) -> float:
        return sum(self.costs.values())


def tag(cutoff: float) -> str:
    """3.5 -> t35."""
    return "t" + str(cutoff).replace(".", "")
