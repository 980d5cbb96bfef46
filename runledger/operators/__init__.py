"""Analytics over records and cells, each a function from DataFrames to DataFrames."""
