"""Imports every plan module so that its queries are registered."""

import importlib
import pkgutil

import mailtriage.plans as plans
from mailtriage.plans.registry import ORACLES, QUERIES  # noqa: F401

for module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"mailtriage.plans.{module.name}")
