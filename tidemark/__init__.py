"""tidemark: keep two live systems of record consistent with Spark jobs.

Sub-packages
------------
sources    landing files, change files, snapshots and mapping metadata
functions  column builders: conversions, keys, small scalars
operators  DataFrame -> DataFrame steps: naming, guard, fold, apply, audit, ...
streaming  the same steps inside Structured Streaming
plans      whole pipelines, the query catalogue and its SQL oracles
"""

__version__ = "0.1.0"
