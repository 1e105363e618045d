from __future__ import annotations

from cairn.sources.tables import Tables

REGISTRY: dict = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` under a key, with the SQL that must agree."""
    def deco(fn):
        assert key not in REGISTRY, key

        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        REGISTRY[key] = (run, sql)
        return fn
    return deco
