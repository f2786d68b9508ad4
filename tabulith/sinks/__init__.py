"""Where results go: a relational schema on Parquet, reports and workbooks."""
