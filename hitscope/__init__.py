"""Web-traffic analytics on Spark: request logs in, panels, rollups and alerts out."""
