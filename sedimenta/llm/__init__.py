"""Operators for texts that language models are trained on. Nothing else in the library imports this subpackage."""
