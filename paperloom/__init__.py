"""Document collections to reviewable Markdown, on Spark DataFrames."""
