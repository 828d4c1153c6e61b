"""All registered queries; importing a module below registers what it holds."""

from planshift.catalog import (  # noqa: F401
    cleaning_encoding,
    filters_scalars,
    jobs,
    joining,
    modelling,
    profiles,
    rankings,
    scans_columns,
    single_split_jobs,
    single_splits,
)
from planshift.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
