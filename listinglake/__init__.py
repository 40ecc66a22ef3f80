"""listinglake: merge event listings from many publishers and search the result, as Spark jobs."""
