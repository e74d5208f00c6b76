"""panelwright: panel features, entity resolution and scoring as Spark jobs."""
