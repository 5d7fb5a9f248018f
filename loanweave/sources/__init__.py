from .credit import credit, credit_dirty, table
from .files import export_csv, from_rows, load_portfolio, normalise, read_applications, read_text, typed
from .quarantine import quarantine, read_checked

__all__ = [
    "credit", "credit_dirty", "table", "export_csv", "from_rows", "load_portfolio", "normalise",
    "quarantine", "read_applications", "read_checked", "read_text", "typed",
]
