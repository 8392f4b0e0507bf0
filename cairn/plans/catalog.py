"""All registered queries; importing the modules fills the registry."""

from cairn.plans import (  # noqa: F401
    q_clean,
    q_features,
    q_metrics,
    q_models,
    q_raster,
    q_sample,
    q_sources,
    q_stats,
)
from cairn.plans.registry import ORACLES, QUERIES  # noqa: F401
