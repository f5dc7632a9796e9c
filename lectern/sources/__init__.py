"""Inputs: files, OCR results, pluggable readers, and derived fixtures."""
