"""Search and analysis of large text corpora on Spark: files of repositories, scanned line by line."""
