"""Ad-event stream analytics written as PySpark DataFrame operators.

``sources``    readers: event topic, campaign table, run results, metric text
``functions``  column expressions shared by batch and streaming
``operators``  DataFrame -> DataFrame steps: parse, count, pair, summarise
``streaming``  the continuous job, its result store, completeness checks
``plans``      whole jobs put together from the above
"""
