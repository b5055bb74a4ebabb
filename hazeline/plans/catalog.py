"""All registered queries (importing a module registers its entries)."""

from hazeline.plans import q_clean, q_features, q_files, q_index, q_models, q_verify  # noqa: F401
from hazeline.plans.registry import ORACLES, QUERIES  # noqa: F401
