"""Training-data operators: cleaning, deduplication, decontamination, mixing and token output.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns
DataFrames; intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""
