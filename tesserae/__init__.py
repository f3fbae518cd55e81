"""Tesserae: declarative data transforms and document analytics compiled to Spark plans."""
