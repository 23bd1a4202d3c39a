"""Imports every query module, so that the registry is filled."""

from graticule.plans import q_catalog, q_engine, q_search, q_text  # noqa: F401
