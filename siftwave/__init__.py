"""Message-screening analytics on Spark: functions from DataFrames and Columns to DataFrames and Columns."""
