from .catalog import batch_ingest, file_catalog
from .exporters import copy_rows, copy_statement, insert_statements, load_data_statement
from .readers import flatten, read_any, read_csv, read_json, read_parquet, read_xml, union_lists

__all__ = ["batch_ingest", "copy_rows", "copy_statement", "file_catalog", "flatten",
           "insert_statements", "load_data_statement", "read_any", "read_csv", "read_json",
           "read_parquet", "read_xml", "union_lists"]
