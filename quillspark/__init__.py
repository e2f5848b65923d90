"""quillspark: session-log and text-corpus analytics expressed as Spark DataFrames."""
