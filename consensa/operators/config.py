"""Configurations with their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

TIES = ("average", "min", "max", "first", "random")
POLICIES = ("ignore", "worst", "drop")
DENOMINATORS = ("unfiltered_ppi_edges", "ppi_filtered_edges")


@dataclass
class Feature:
    column: str
    weight: float = 1.0
    direction: str = "lower_better"

    def __post_init__(self):
        if self.direction not in ("lower_better", "higher_better"):
            raise ValueError(f"direction of {self.column}: {self.direction}")
        if not math.isfinite(self.weight):
            raise ValueError(f"weight of {self.column} is not finite")


@dataclass
class BordaConfig:
    features: list[Feature]
    ties: str = "average"
    na_policy: str = "ignore"
    aliases: dict[str, list[str]] = field(default_factory=dict)
    digits: int = 4
    seed: int = 1

    def __post_init__(self):
        if self.ties not in TIES:
            raise ValueError(f"ties: {self.ties}")
        if self.na_policy not in POLICIES:
            raise ValueError(f"na_policy: {self.na_policy}")
        if not self.features or not sum(f.weight for f in self.features):
            raise ValueError("weights must not sum to zero")

    @classmethod
    def from_dict(cls, d: dict) -> BordaConfig:
        features = [Feature(name, float(x.get("weight", 1)), x.get("direction", "lower_better")) for name, x in d["features"].items()]
        return cls(features, d.get("ties", "average"), d.get("na_policy", "ignore"), d.get("aliases", {}), int(d.get("digits", 4)))

    def resolve(self, columns: list[str]) -> list[tuple[Feature, str | None]]:
        """Each feature with its column: by name, by alias, or with the other network prefix; None if absent."""
        have = set(columns)

        def find(name: str) -> str | None:
            options = [name, *self.aliases.get(name, [])]
            for a, b in (("Net_", "Network_"), ("Network_", "Net_")):
                if name.startswith(a):
                    options.append(b + name[len(a) :])
            return next((o for o in options if o in have), None)

        return [(f, find(f.column)) for f in self.features]


@dataclass
class FilterConfig:
    top_prop: float = 0.2
    enrich: bool = True
    add_prop: float = 0.05
    denominator: str = "unfiltered_ppi_edges"
    require_membrane_endpoint: bool = True
    metric: str = "absolute_weight"

    def __post_init__(self):
        if not 0 < self.top_prop <= 1:
            raise ValueError("top_prop must be in (0, 1]")
        if not 0 <= self.add_prop <= 1:
            raise ValueError("add_prop must be in [0, 1]")
        if self.metric != "absolute_weight":
            raise ValueError(f"metric: {self.metric}")
        if self.denominator not in DENOMINATORS:
            raise ValueError(f"denominator: {self.denominator}")
        if not self.require_membrane_endpoint:
            raise ValueError("require_membrane_endpoint must be true")

    @classmethod
    def from_dict(cls, d: dict) -> FilterConfig:
        """Also reads the older keys: a top-level top_prop, and mem_prop = 1 - add_prop."""
        ppi, mem = d.get("ppi", {}), d.get("membrane", {})
        add = mem.get("add_prop", 1 - mem["mem_prop"] if "mem_prop" in mem else 0.05)
        return cls(
            ppi.get("top_prop", d.get("top_prop", 0.2)), mem.get("enabled", True), add, mem.get("denominator", "unfiltered_ppi_edges"),
            mem.get("require_membrane_endpoint", True), mem.get("metric", "absolute_weight"),
        )
