"""Storage of runs, log and manifest on any file system that Spark knows."""
