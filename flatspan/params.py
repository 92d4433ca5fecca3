"""Validated hyperparameters with a JSON round trip."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


def bounded(default, low=None, high=None, choices=None, also=()):
    """A dataclass default with inclusive bounds; ``also`` lists values allowed outside them."""
    from dataclasses import field

    return field(default=default, metadata={"low": low, "high": high, "choices": choices, "also": also})


@dataclass(frozen=True)
class Params:
    def __post_init__(self):
        for f in fields(self):
            v, m = getattr(self, f.name), f.metadata
            if not m or v in m["also"]:
                continue
            if m["choices"] and v not in m["choices"]:
                raise ValueError(f"{f.name} must be one of {m['choices']}, not {v!r}")
            if (m["low"] is not None and v < m["low"]) or (m["high"] is not None and v > m["high"]):
                raise ValueError(f"{f.name} = {v} is outside {m['low']} .. {m['high']}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str):
        return cls(**json.loads(text))


@dataclass(frozen=True)
class KSubspacesParams(Params):
    n_clusters: int = bounded(2, 2)
    dim_subspaces: int = bounded(2, 1, 50)
    random_seed: int = bounded(0)


@dataclass(frozen=True)
class EnsembleParams(Params):
    n_clusters: int = bounded(2, 2)
    dim_subspaces: int = bounded(2, 1, 50)
    n_base: int = bounded(100, 10, 1000)
    thresh: int = bounded(5, 1, 10000, also=(-1,))
    trim: str = bounded("drop_smallest", choices=("drop_smallest", "keep_top"))
    random_seed: int = bounded(0)


@dataclass(frozen=True)
class SscAdmmParams(Params):
    n_clusters: int = bounded(2, 2)
    use_affine: bool = bounded(False)
    use_outliers: bool = bounded(True)
    alpha: int = bounded(-1, 20, 800, also=(-1,))
    epsilon: float = bounded(0.0002, 0)
    random_seed: int = bounded(0)


@dataclass(frozen=True)
class SscConvexParams(Params):
    n_clusters: int = bounded(2, 2)
    use_affine: bool = bounded(False)
    use_outliers: bool = bounded(True)
    use_noise: bool = bounded(True)
    alpha: int = bounded(-1, 20, 800, also=(-1,))
    random_seed: int = bounded(0)


@dataclass(frozen=True)
class SscOmpParams(Params):
    n_clusters: int = bounded(2, 2)
    sparsity_level: int = bounded(3, 3, 50)
    thresh: float = bounded(1e-6, 1e-10, 1)
    random_seed: int = bounded(0)


@dataclass(frozen=True)
class OwlParams(Params):
    weight_type: str = bounded("linear", choices=("linear",))
    weight_max_val: float = bounded(0.01, 0)
    weight_max_off: int = bounded(0, 0)
    weight_min_val: float = bounded(0.01, 0)
    weight_min_off: int = bounded(0, 0)
    fit_intercept: bool = bounded(True)
    normalize: bool = bounded(False)
    tol: float = bounded(1e-3, 0)
    learning_rate: float = bounded(1e-3, 0)
    verbose: int = bounded(0, 0, 2)
    random_seed: int = bounded(0)

    def __post_init__(self):
        super().__post_init__()
        if self.weight_max_off > self.weight_min_off or self.weight_max_val < self.weight_min_val:
            raise ValueError("weights must not rise: max_off <= min_off and max_val >= min_val")
