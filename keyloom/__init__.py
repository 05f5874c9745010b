"""keyloom: a join laboratory on Spark.

One logical operator, the inner equi-join of keyed integer relations, with
interchangeable physical strategies, explicit radix partitioning, scans,
reductions, generators and a streaming probe.
"""
