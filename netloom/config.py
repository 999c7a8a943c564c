"""Settings of a training run and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.training import TASK_WEIGHTS

LEAST_LAYERS = 4


@dataclass
class RunConfig:
    node_features: int = 17
    edge_features: int = 5
    layers: int = 6
    tasks: tuple[str, ...] = ("slack", "arrival_time", "required_time")
    weights: dict[str, float] = field(default_factory=lambda: dict(TASK_WEIGHTS))

    def validate(self) -> "RunConfig":
        """self, or a ValueError that says what is wrong."""
        for name in ("node_features", "edge_features"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        missing = [t for t in self.tasks if t not in self.weights]
        if missing:
            raise ValueError(f"no weight for: {', '.join(missing)}")
        return self

    def depth(self) -> int:
        """Layers of a timing backbone: those asked for, LEAST_LAYERS at least."""
        return max(self.layers, LEAST_LAYERS)
