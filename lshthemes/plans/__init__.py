"""Whole dataflows: loading and building a model, finding themes, searching with a report."""

from lshthemes.plans.models import LoadedModel, LoadedModels, index_model, load_model
from lshthemes.plans.search import SearchReport, search_by_density, search_text
from lshthemes.plans.themes import Themes, discover_themes

__all__ = [
    "LoadedModel",
    "LoadedModels",
    "SearchReport",
    "Themes",
    "discover_themes",
    "index_model",
    "load_model",
    "search_by_density",
    "search_text",
]
