"""Importing this module registers every query."""

from importlib import import_module

MODULES = ["packets", "tables", "streams", "guides", "readers", "media", "live"]
for _m in MODULES:
    import_module(f"airlens.plans.{_m}")
