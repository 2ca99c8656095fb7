"""voxelspan: point-cloud analytics expressed as Spark DataFrame plans."""
