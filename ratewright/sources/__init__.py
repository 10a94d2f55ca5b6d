"""Typed scans and sinks."""

from .artefacts import append_embeddings, load_table, publish, published, read_embeddings, save_table, versioned
from .features import read_features, write_features
from .tables import scan, scan_raw_folder, write_submission

__all__ = [
    "append_embeddings",
    "load_table",
    "publish",
    "published",
    "read_embeddings",
    "read_features",
    "save_table",
    "scan",
    "scan_raw_folder",
    "versioned",
    "write_features",
    "write_submission",
]
