"""glyphmill: a Spark-first engine for reading, scoring and cleaning web text corpora."""
