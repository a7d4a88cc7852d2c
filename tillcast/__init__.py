"""tillcast: retail demand analytics as Spark DataFrame jobs.

Transactions, item master data and promotion plans go in; daily demand,
a gap-free date x item table, time-series features, profiles, tree models
and a monetary forecast score come out. Every step is a function
``DataFrame -> DataFrame``; train and test travel through the same code with
``split`` as a column.
"""

from tillcast.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
