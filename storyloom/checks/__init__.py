"""Queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ["texts", "landed", "stores", "readers", "streams"]


def _load():
    from . import base

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return base


def all_queries():
    base = _load()
    return {name: _utc(fn) for name, fn in base.QUERIES.items()}


def all_oracles():
    return dict(_load().ORACLES)


def _utc(fn):
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run
