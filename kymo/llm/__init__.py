"""Operators for building training corpora: self-contained, imported by nothing else in the library."""
