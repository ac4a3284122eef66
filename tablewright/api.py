"""The public names in one place."""

from tablewright.config import ExploreConfig, ImportanceConfig, ImputationConfig, PlotConfig, SchemaConfig
from tablewright.figures import FigureSink, apply_style
from tablewright.operators.columns import ColumnSpec, CountStore, delta, load_findings, profile_loads
from tablewright.operators.correlate import Correlations, correlations
from tablewright.operators.explore import Exploration, explore
from tablewright.operators.impute import Filler, Imputed, Imputer, impute, neighbour_fills
from tablewright.operators.profile import Profile, profile
from tablewright.operators.propagate import Edge, Filled, fill_missing, near
from tablewright.operators.rejects import Field, LoadedLines, load_lines
from tablewright.operators.roles import Roles, classify, coerce, numeric_fractions
from tablewright.operators.supervise import RANKINGS, Study, importance_study, infer_task
from tablewright.operators.validate import Validation, validate
from tablewright.sources.io import CsvSource, ExcelSource, Source, SourceError, load, source_for, with_row_key, write_frame

__all__ = [n for n in dir() if not n.startswith("_")]
