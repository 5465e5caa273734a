"""shardloom: JSON document sharding, structure analytics and corpus preparation on Spark."""

__version__ = "1.0.0"
