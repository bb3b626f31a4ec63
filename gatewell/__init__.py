"""gatewell: privacy-gated transaction analytics as Spark jobs."""
