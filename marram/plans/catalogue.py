"""Registered queries over the driver's tables, and the SQL that checks them."""

from marram.plans import association, estimation, imaging, mapping, readback  # noqa: F401  (they register themselves)
from marram.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
