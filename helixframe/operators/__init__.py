"""Analyses of trajectories and umbrella samples."""
