"""Readers of trajectories, topologies, text structures and samples."""
