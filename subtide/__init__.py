"""subtide: Spark-first operators for media metadata, subtitles, timing data and corpus preparation."""
