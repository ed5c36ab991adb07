"""Panel forecasting and change monitoring expressed as Spark DataFrame plans."""
