"""Market-panel analytics on Spark DataFrames.

Layers, bottom up:

* ``functions``  column expressions (calendar, numbers, seasonal terms)
* ``operators``  ``DataFrame -> DataFrame`` steps keyed by series or market
* ``sources``    readers with declared schemas, and the TPC-H stand-in views
* ``plans``      whole pipelines: features, training sets, models, scenarios
"""
