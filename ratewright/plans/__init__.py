"""Whole runs: prepare, train, predict, evaluate."""

from .evaluate import evaluate, upload_check
from .predict import predict
from .prepare import Prepared, TextSettings, prepare
from .train import TrainingReport, train

__all__ = ["Prepared", "TextSettings", "TrainingReport", "evaluate", "predict", "prepare", "train", "upload_check"]
