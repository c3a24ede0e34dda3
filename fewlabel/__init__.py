"""fewlabel: label-scarce text classification data as Spark DataFrame jobs.

Every public operator takes and returns DataFrames so that steps chain with
``df.transform``.  Randomness is a seeded md5 hash of the row key, so results do
not depend on partitioning, executor count or retries.
"""

from fewlabel.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
