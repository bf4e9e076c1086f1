"""All registered queries."""

from netlens.plans import detections_catalog, features_catalog, flows_catalog, models_catalog, sources_catalog, texts_catalog  # noqa: F401
from netlens.plans.registry import QUERIES, SQL  # noqa: F401
