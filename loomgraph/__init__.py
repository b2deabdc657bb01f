"""Analytics over software-delivery data as Spark DataFrames: normalisation, property graphs, named questions, diffs and streams."""
