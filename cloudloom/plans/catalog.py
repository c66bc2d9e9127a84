"""Imports the modules that register queries."""

from cloudloom.plans import q_clusters, q_features, q_files, q_models, q_points  # noqa: F401
