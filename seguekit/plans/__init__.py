"""Registered queries over the test-data views; ``load()`` imports them all."""

import importlib

MODULES = ("scalar_queries", "catalogue_queries", "corpus_queries", "series_queries", "peak_queries", "spectra_queries", "live_queries", "point_queries", "flag_queries", "curve_queries", "source_queries", "plane_queries", "set_queries")


def load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
