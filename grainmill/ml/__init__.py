"""Feature assembly, models, evaluation, forecasts and explanations on DataFrames."""
