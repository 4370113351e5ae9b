"""Signal analytics as Spark DataFrame operators.

``functions``  expressions and Arrow kernels      ``operators``  DataFrame in, DataFrame out
``sources``    files, PCM, index tables, exports   ``plans``      whole measurements and queries
``streaming``  Structured Streaming variants of the batch operators
"""
