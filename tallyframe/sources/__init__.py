"""Sources: the ticket CSV, stage materialisation, fixture projections."""

from tallyframe.sources.intake import Intake, TooManyRejects, header_lines, take_in, text_records
from tallyframe.sources.records import (
    TICKET_COLUMNS,
    clean_name,
    normalize_columns,
    read_records,
    register_stage,
    reject_counts,
)
from tallyframe.sources.stage import StageFolder, shared_root

__all__ = [
    "Intake",
    "StageFolder",
    "TICKET_COLUMNS",
    "TooManyRejects",
    "clean_name",
    "header_lines",
    "normalize_columns",
    "read_records",
    "register_stage",
    "reject_counts",
    "shared_root",
    "take_in",
    "text_records",
]
