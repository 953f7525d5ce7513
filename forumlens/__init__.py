"""Forum evidence analytics as Spark jobs: load, merge, label, retrieve, report."""
