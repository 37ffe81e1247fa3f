"""shiftcast: workload aggregation, forecasting and staffing on Spark DataFrames.

Every capability is a function from DataFrame to DataFrame (or to a small dict
of DataFrames); nothing runs until the caller acts on the result.
"""
