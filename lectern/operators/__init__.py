"""Document-structuring operators over DataFrames."""
