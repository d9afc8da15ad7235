"""cairn: catalog-style analytics and data-quality operators as Spark DataFrames."""
