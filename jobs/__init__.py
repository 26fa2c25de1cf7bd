"""Runnable jobs over the engine: `python -m jobs.trajectory_export`, `python -m jobs.umbrella_ingest`."""
