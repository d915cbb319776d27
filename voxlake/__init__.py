"""A PySpark-native engine for image stacks, voxel volumes and atom tables."""
