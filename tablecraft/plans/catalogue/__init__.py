"""All registered queries; importing this package fills the registry."""

from tablecraft.plans.catalogue import (  # noqa: F401
    charts, cleaning, documents, learning, profiles, series, sources, tables,
)
from tablecraft.plans.catalogue.registry import ORACLE, QUERIES, load  # noqa: F401
