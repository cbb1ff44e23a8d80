"""attesta: provenance-aware knowledge and work-memory tables as Spark jobs."""
