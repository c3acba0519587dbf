"""pointweave: Spark jobs for the analysis of coloured point clouds and their compression."""
