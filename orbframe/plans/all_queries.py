"""Importing this module registers every query."""

from orbframe.plans import depth_queries, fill_queries, job_queries, media_queries, render_queries, sphere_queries, stream_queries, time_queries, warp_queries  # noqa: F401
from orbframe.plans.registry import ORACLES, QUERIES  # noqa: F401
