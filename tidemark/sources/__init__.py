"""Reading and writing annotations, manifests, features, predictions and run records."""
from .annotations import read_events, read_manifest, read_summary, write_manifests, write_split, write_summary
from .features import consolidate, event_feature_index, read_bank, read_event_features
from .files import file_fingerprint, file_index, fingerprint, read_outputs, read_runs, write_outputs
from .predictions import prediction_rows, write_predictions

__all__ = [name for name in dir() if not name.startswith("_")]
