"""Whole pipelines: build, describe, screen, ablate, and the experiment grid."""
