"""Query registry: Spark callables beside the SQL that checks them."""

from functools import wraps

from plumbline.plans.session import ship_package
from plumbline.workload import views

QUERIES = {}
ORACLES = {}


def query(name, sql=None, using=()):
    """Register fn(spark, sf_dir) -> DataFrame; `using` names the views the SQL reads."""

    def register(fn):
        @wraps(fn)
        def run(spark, sf):
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(using, sql)
        return fn

    return register


def r(expr, digits=6):
    """SQL twin of functions.numeric.settle."""
    scale = f"CAST(1{'0' * digits} AS DOUBLE)"
    return f"floor(CAST({expr} AS DOUBLE)*{scale}+CAST(0.4999 AS DOUBLE))/{scale}"
