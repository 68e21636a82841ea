"""Page audit, entity registry and contact enrichment as Spark DataFrame operators."""
