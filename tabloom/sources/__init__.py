"""Readers and writers: markdown, CSV, JSON, tables with trees as headers; parquet and the like are Spark's own."""

from .csv import read_csv, write_csv
from .dataset import load_dataset, load_metadata
from .hierarchical import read_hierarchical
from .markdown import read_markdown, to_markdown

__all__ = ["load_dataset", "load_metadata", "read_csv", "read_hierarchical", "read_markdown", "to_markdown", "write_csv"]
