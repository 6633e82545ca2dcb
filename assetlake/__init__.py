"""assetlake: Spark jobs over lakes of binary assets."""
