"""tollgate: subscription, capacity, service-metric and site-audit jobs on Spark.

Every operator is a plain function from DataFrames to a DataFrame built from
Spark's built-in functions, so Catalyst can prune, push down and plan it.
"""

from tollgate.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
