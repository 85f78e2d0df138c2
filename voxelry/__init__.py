"""Digital topology of images and volumes on Spark: voxel tables in, well-composed fields, metrics and tests out."""
