"""Composed jobs: order fixture, star schema, reports, lineage, pipeline."""
