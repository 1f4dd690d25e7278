"""Spark-first analytics over a media library: catalogue, lists, faces, scenes, triage."""
