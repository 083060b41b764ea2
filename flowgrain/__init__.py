"""flowgrain: trainable data-processing pipelines on Spark DataFrames."""
