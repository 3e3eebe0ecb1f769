"""Registered queries, each with the SQL that must give the same rows."""


def registered() -> list:
    from . import cases, evidence, raster, regions, scenes, scoring, stores, tracks, weather

    return [tracks, scoring, weather, raster, regions, cases, evidence, scenes, stores]
