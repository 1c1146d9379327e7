"""folio_spark: rule-driven text harvesting and curation as Spark jobs."""
