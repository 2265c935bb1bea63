"""Estimators, evaluation, training runs and scoring."""
