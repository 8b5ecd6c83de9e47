"""thermoflux: Spark DataFrame operators for site-keyed environmental time series."""
