"""Named queries over the test tables, and the same in DuckDB's SQL."""

from . import cleaning, cohorts, comparison, entities, funds, growth, holdings, plain, reports, sources, snapshots, supplements  # noqa: F401
from .fixtures import QUERIES, SQL  # noqa: F401
