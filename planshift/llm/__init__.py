"""Operators for building language-model training data at corpus scale, and their registered queries."""
