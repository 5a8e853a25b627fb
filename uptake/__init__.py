"""Adoption analytics on Spark: cleaning, reshaping, growth metrics, reconciliation, forecasts.

Layers, lowest first:

* ``functions``  column expressions (text, numbers, labels, dates)
* ``sources``    readers, header handling, sheet layouts, sinks
* ``operators``  DataFrame to DataFrame building blocks
* ``plans``      composed preparations and reports
* ``workloads``  the registered queries over the driver's tables and their SQL oracles
"""
