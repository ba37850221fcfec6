from .files import preview, prepare_source, read_csv, read_parquet, to_records, with_row_index
from .workspace import read_workspace, write_workspace

__all__ = [
    "preview", "prepare_source", "read_csv", "read_parquet", "read_workspace",
    "to_records", "with_row_index", "write_workspace",
]
