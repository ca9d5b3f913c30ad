"""Where rows come from and go to: databases of Parquet tables, delimited text, CSV."""

from .database import Database
from .text import read_text, show, write_csv

__all__ = ["Database", "read_text", "show", "write_csv"]
