"""Transcript and corpus jobs on Spark."""
