"""gridmill: curate, predict and score (table image, HTML) datasets as Spark DataFrame jobs."""
