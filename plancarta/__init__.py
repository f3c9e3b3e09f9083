"""Plan-map analytics on Spark: regions, trails and registries as DataFrame operators."""
