"""Image-track analysis as Spark jobs over long tables."""
