"""Whole jobs: prepare a split, build a feature bank, evaluate predictions."""
from .banks import build_bank, build_event_features, check_features
from .evaluation import anticipation_scores, validation_history
from .preparation import prepare_grouped, prepare_hybrid

__all__ = ["anticipation_scores", "build_bank", "build_event_features", "check_features", "prepare_grouped", "prepare_hybrid", "validation_history"]
