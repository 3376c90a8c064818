"""Table transformations: staging, resolution, data quality, marts, time series, forecasting, policy, monitoring."""
