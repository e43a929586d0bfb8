"""Parameters of the operators, as closed classes: unknown keys and values are errors.

The defaults are fixed values of the workflow.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any, Self


def _one_of(name: str, value: Any, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


class Closed:
    @classmethod
    def from_dict(cls, values: Mapping[str, Any] | None) -> Self:
        values = dict(values or {})
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ValueError(f"{cls.__name__} has no {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class InputConfig(Closed):
    coord_columns: tuple[str, str] = ("x", "y")
    cell_id_column: str | None = None
    cell_type_column: str | None = "cell_type"
    features: str | tuple[str, ...] | None = "all"
    sep: str = ","

    def __post_init__(self) -> None:
        if isinstance(self.features, str):
            _one_of("features", self.features, ("all",))


@dataclass(frozen=True)
class TilingConfig(Closed):
    size: float = 200.0
    stride: float = 200.0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.stride <= 0:
            raise ValueError("size and stride must be positive")


@dataclass(frozen=True)
class GraphConfig(Closed):
    edge_features: tuple[str, ...] = ("log_distance", "neighbor")
    neighbor_cutoff: float = 20.0
    log_distance_bounds: tuple[float, float] = (2.0, 5.0)

    def __post_init__(self) -> None:
        for f in self.edge_features:
            _one_of("edge feature", f, ("log_distance", "distance", "neighbor"))
        if self.log_distance_bounds[0] >= self.log_distance_bounds[1]:
            raise ValueError("log_distance_bounds must increase")


@dataclass(frozen=True)
class BuildConfig(Closed):
    unit: str = "region"
    coord_scale_um: float = 1.0
    min_cells: int = 10

    def __post_init__(self) -> None:
        _one_of("unit", self.unit, ("region", "tile", "polygon"))


@dataclass(frozen=True)
class ReducerConfig(Closed):
    name: str = "identity"
    n_components: int = 32
    fit_on: str = "all"
    state_from: str | None = None

    def __post_init__(self) -> None:
        _one_of("name", self.name, ("identity", "pca"))
        _one_of("fit_on", self.fit_on, ("all", "train"))


@dataclass(frozen=True)
class InteriorConfig(Closed):
    enabled: bool = False
    n_hops: int | None = None
    hull_tolerance: float = 1.0
    keep_largest_component: bool = True


@dataclass(frozen=True)
class EgoRadiusConfig(Closed):
    enabled: bool = False
    radius_per_hop: float = 75.0
    radius_offset: float = 55.0
    keep_root_component: bool = True

    def radius(self, depth: int) -> float:
        return self.radius_per_hop * depth + self.radius_offset


@dataclass(frozen=True)
class SamplerConfig(Closed):
    depth: int = 4
    num_neighbors: int = -1
    roots_per_unit: int | None = 256
    batch_size: int = 64
    merge_units: bool = False
    root_weighting: str | None = None
    interior_roots: InteriorConfig = InteriorConfig()
    ego_radius: EgoRadiusConfig = EgoRadiusConfig()

    def __post_init__(self) -> None:
        for name, kind in (("interior_roots", InteriorConfig), ("ego_radius", EgoRadiusConfig)):
            if not isinstance(getattr(self, name), kind):
                object.__setattr__(self, name, kind.from_dict(getattr(self, name)))
        if self.depth < 1:
            raise ValueError("depth must be at least 1")
        if self.roots_per_unit is not None and self.roots_per_unit < 1:
            raise ValueError("roots_per_unit must be positive or absent")
        _one_of("root_weighting", self.root_weighting, (None, "inverse", "sqrt_inverse"))


@dataclass(frozen=True)
class ClusteringConfig(Closed):
    space: str = "attention"
    pca: int | None = None
    metric: str = "cosine"
    method: str = "hdbscan"
    min_cluster_size: int = 300
    min_samples: int = 1
    selection: str = "eom"
    n_clusters: int = 10
    sample_size: int = 100_000
    assign_k: int = 15
    seed: int = 0

    def __post_init__(self) -> None:
        _one_of("space", self.space, ("attention", "embedding"))
        _one_of("metric", self.metric, ("cosine", "euclidean"))
        _one_of("method", self.method, ("hdbscan", "kmeans"))
        _one_of("selection", self.selection, ("eom", "leaf"))


@dataclass(frozen=True)
class DescriptorConfig(Closed):
    analyses: tuple[str, ...] = ("moran", "enrichment", "cross_l", "contacts")
    min_cells: int = 20
    n_perms: int = 100
    n_radii: int = 20
    max_radius: float | None = None
    min_contacts: int = 100
    max_edge_length: float | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        for a in self.analyses:
            _one_of("analysis", a, ("moran", "enrichment", "cross_l", "contacts"))


@dataclass(frozen=True)
class SpatialStatsConfig(Closed):
    compare_by: str = "patient"
    analyses: tuple[str, ...] = ("enrichment", "neighbourhoods", "contacts", "cross_l")
    reference: tuple[str, ...] = ()
    window: int = 10
    n_neighbourhoods: int = 10
    sample_size: int = 200_000
    radii: tuple[float, ...] = (20.0, 50.0, 100.0)
    min_patients: int = 10
    seed: int = 0

    def __post_init__(self) -> None:
        _one_of("compare_by", self.compare_by, ("patient", "unit"))
        for a in self.analyses:
            _one_of("analysis", a, ("enrichment", "neighbourhoods", "contacts", "cross_l"))


@dataclass(frozen=True)
class SurvivalConfig(Closed):
    patient_id: str = "patient_id"
    time: str = "time"
    event: str = "event"
    pseudo_share: float = 1e-3
    score: tuple[str, ...] = ()


def fingerprint(*parts: Closed | str) -> str:
    """The first 16 hex digits of SHA-1 over the parts, dictionaries with sorted keys."""
    import hashlib
    import json

    text = json.dumps([p if isinstance(p, str) else p.as_dict() for p in parts], sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class InputSpec(Closed):
    """What a model needs of its input; a consumer must match it in all fields."""

    features: tuple[str, ...] = ()
    cell_types: tuple[str, ...] = ()
    edge_features: tuple[str, ...] = ()
    preprocessing: str = ""

    def check_matches(self, other: InputSpec, what: str) -> None:
        if wrong := [f.name for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)]:
            raise ValueError(f"{what} differs in {wrong}")


@dataclass(frozen=True)
class EncoderConfig(Closed):
    hidden_dim: int = 256
    out_dim: int = 256
    num_layers: int = 4
    dropout: float = 0.0
    norm: str = "layernorm"
    jk: str = "last"
    act: str = "relu"
    pooling: str = "max"
    mlp_ratio: int = 2
    train_eps: bool = True
    edge_feature: int | None = 0
    input_init: str = "xavier"
    unassigned_cell_type: str | None = None

    def __post_init__(self) -> None:
        _one_of("norm", self.norm, ("layernorm", "batchnorm", "none"))
        _one_of("jk", self.jk, ("last", "concat", "max", "sum"))
        _one_of("act", self.act, ("relu", "gelu", "leaky_relu"))
        _one_of("pooling", self.pooling, ("max", "mean", "sum"))
        _one_of("input_init", self.input_init, ("xavier", "default"))


@dataclass(frozen=True)
class HeadConfig(Closed):
    num_layers: int = 1
    hidden_dim: int | None = None
    dropout: float = 0.0
    act: str = "leaky_relu"

    def __post_init__(self) -> None:
        _one_of("act", self.act, ("leaky_relu", "relu", "gelu"))


@dataclass(frozen=True)
class AttentionConfig(Closed):
    projection_dim: int = 32
    hidden_dim: int = 8
    dropout: float = 0.25
    init: str = "kaiming"

    def __post_init__(self) -> None:
        _one_of("init", self.init, ("kaiming", "default"))


@dataclass(frozen=True)
class ProbeConfig(Closed):
    roots_per_unit: int | None = 96
    seed: int = 0
    C: float = 1.0
    class_weight: str | None = "balanced"
    max_iter: int = 3000

    def __post_init__(self) -> None:
        _one_of("class_weight", self.class_weight, (None, "balanced"))


@dataclass(frozen=True)
class PretrainViews(Closed):
    mu: float = 0.25
    p_lambda: float = 0.45
    noise_std: float = 0.2
    noise_features: tuple[str, ...] = ()


@dataclass(frozen=True)
class FinetuneAugmentation(Closed):
    drop_edge_p: float = 0.0
    mask_node_p: float = 0.0
    seed: int = 0

    @property
    def enabled(self) -> bool:
        return self.drop_edge_p > 0 or self.mask_node_p > 0


@dataclass(frozen=True)
class SelectionConfig(Closed):
    metric: str = "val/auroc"
    mode: str = "max"
    patience: int = 8

    def __post_init__(self) -> None:
        _one_of("mode", self.mode, ("max", "min"))


@dataclass(frozen=True)
class TaskConfig(Closed):
    target_type: str = "classification"
    target_columns: tuple[str, ...] | None = None
    num_classes: int = 2
    class_weights: str | tuple[float, ...] | None = "auto"
    loss: str = "mse"
    huber_delta: float = 1.0
    cox_regularization: float = 0.0
    selection: SelectionConfig | None = None

    def __post_init__(self) -> None:
        _one_of("target_type", self.target_type, ("classification", "regression", "survival"))
        _one_of("loss", self.loss, ("mse", "huber"))
        if self.target_type == "survival" and len(self.target_columns or ()) != 2:
            raise ValueError("survival needs two target columns, time and event")
        if self.target_type == "regression" and not self.target_columns:
            raise ValueError("regression needs target columns")
        chosen = {"classification": ("val/auroc", "max"), "regression": ("val/rmse", "min"), "survival": ("val/c_index", "max")}[self.target_type]
        given = self.selection
        if not isinstance(given, SelectionConfig):
            object.__setattr__(self, "selection", SelectionConfig(*chosen) if given is None else SelectionConfig.from_dict(given))


@dataclass(frozen=True)
class FinetuneConfig(Closed):
    lr_scales: Mapping[str, float] = field(default_factory=lambda: {"encoder": 1.0, "head": 0.01, "attention": 2.0})
    head_weight_decay: float | None = 1e-3
    head_init: str = "probe"
    hyperbatch_size: int = 12
    grad_clip_norm: float = 1.0
    warmup_steps: int = 0
    schedule_epochs: int | None = None
    augmentation: FinetuneAugmentation = FinetuneAugmentation()
    probe: ProbeConfig = ProbeConfig()

    def __post_init__(self) -> None:
        for name, kind in (("augmentation", FinetuneAugmentation), ("probe", ProbeConfig)):
            if not isinstance(getattr(self, name), kind):
                object.__setattr__(self, name, kind.from_dict(getattr(self, name)))
        if set(self.lr_scales) != {"encoder", "head", "attention"} or any(not isinstance(v, int | float) or v < 0 for v in self.lr_scales.values()):
            raise ValueError("lr_scales needs a number of 0 or more for encoder, head and attention")
        _one_of("head_init", self.head_init, ("probe", "random"))
        if self.hyperbatch_size < 1:
            raise ValueError("hyperbatch_size must be at least 1")


#: Regimes: what each sets differently from the defaults of FinetuneConfig.
REGIMES: dict[str, dict[str, Any]] = {
    "finetune": {},
    "finetune_reg": {"lr_scales": {"encoder": 0.3, "head": 0.01, "attention": 2.0}, "augmentation": {"drop_edge_p": 0.05, "mask_node_p": 0.05}},
    "mlp_head": {"lr_scales": {"encoder": 1.0, "head": 1.0, "attention": 2.0}, "head_weight_decay": None, "head_init": "random"},
    "attention_only": {"lr_scales": {"encoder": 0.0, "head": 0.0, "attention": 2.0}},
}


def regime(name: str) -> FinetuneConfig:
    """The fine-tuning parameters of a regime."""
    _one_of("regime", name, tuple(REGIMES))
    return FinetuneConfig.from_dict(REGIMES[name])
