"""Settings of the operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# The thresholds here and the defaults of the settings below.
NUMERIC_THRESHOLD = 0.9
DOMINANCE_THRESHOLD = 0.90
SKEW_THRESHOLD = 1.0
SATURATION_THRESHOLD = 0.5


@dataclass(frozen=True)
class SchemaConfig:
    numeric_threshold: float = NUMERIC_THRESHOLD
    id_columns: tuple[str, ...] = ("PAT_ID",)
    outcome_columns: tuple[str, ...] = ("Y1", "Y2", "Y3", "Y4", "Y5")

    def __post_init__(self):
        if not 0 < self.numeric_threshold <= 1:
            raise ValueError("numeric_threshold must lie above 0 and not above 1")


@dataclass(frozen=True)
class ImputationConfig:
    n_neighbors: int = 20
    weights: str = "distance"
    categorical_placeholder: str = "MISSING"
    keep_original_columns: bool = False
    skip_columns: tuple[str, ...] = ()
    distance_columns: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.n_neighbors < 1:
            raise ValueError("n_neighbors must be at least 1")
        if self.weights not in ("distance", "uniform"):
            raise ValueError("weights must be 'distance' or 'uniform'")


@dataclass(frozen=True)
class ExploreConfig:
    top_n_distributions: int = 12
    top_n_pairplot: int = 4
    max_pairplot_rows: int = 1000
    max_clustermap_rows: int = 1000
    max_tsne_rows: int = 2000
    tsne_perplexity: float = 30.0
    max_hue_cardinality: int = 10
    random_state: int = 42


@dataclass(frozen=True)
class ImportanceConfig:
    target_column: str
    test_size: float = 0.20
    random_state: int = 42
    n_permutation_repeats: int = 10
    top_n_features: int = 30
    max_shap_rows: int = 2000
    max_classification_classes: int = 10
    rounds: int = 20
    depth: int = 4
    step: float = 0.3

    def __post_init__(self):
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie between 0 and 1")


@dataclass(frozen=True)
class PlotConfig:
    style: str = "whitegrid"
    context: str = "notebook"
    width: float = 10.0
    height: float = 6.0
    dpi: int = 150
    sequential: str = "viridis"
    diverging: str = "coolwarm"
