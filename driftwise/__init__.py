"""driftwise — data quality, drift monitoring and cost-sensitive decisioning as Spark jobs."""

__version__ = "0.1.0"
