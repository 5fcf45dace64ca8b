"""retailspark — retail customer analytics expressed as Spark DataFrame jobs.

Every public function takes and returns lazy DataFrames (or a small frozen
parameter object); nothing row-sized is collected to the driver.
"""

__all__ = ["session"]
