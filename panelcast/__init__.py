"""panelcast: longitudinal-panel forecasting benchmark operators on PySpark DataFrames."""
