"""Per-document text work in plain Python, without Spark: sample text is only ever data here, nothing of it is run."""
