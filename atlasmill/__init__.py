"""atlasmill: place resolution, serving queries and corpus preparation as Spark jobs."""
