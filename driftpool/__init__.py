"""Online regression over many drifting streams, expressed as Spark jobs."""
