"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the folder named by
``spark.checkpoint.dir`` so that the loss of an executor costs a task, not a job.
"""
