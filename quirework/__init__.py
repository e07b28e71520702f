"""Document analytics on Spark DataFrames: ebook corpora in, query-ready tables out."""
