"""Operators for training-data pipelines. Nothing else in keyloom imports this subpackage."""
