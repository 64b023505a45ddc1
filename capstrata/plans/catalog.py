"""All registered queries. Importing a module registers its queries."""

from capstrata.plans import q_clouds, q_contracts, q_depth, q_geometry, q_integrity, q_reviews, q_timeseries, q_tracks  # noqa: F401
from capstrata.plans.registry import QUERIES  # noqa: F401
