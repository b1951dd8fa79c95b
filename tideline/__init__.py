"""Log archive engine on PySpark: shipping, merging, retention, telemetry, tail."""
