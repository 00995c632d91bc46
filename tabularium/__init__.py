"""Register and survey statistics as Spark DataFrame jobs.

``functions``  column expressions (recodes, null rules, rounding, text)
``operators``  DataFrame to DataFrame (lookups, joins, counts, pivots, unions)
``sources``    scans, text sheets, catalogue lists, sinks
``plans``      the published tables and reports, built from the above
``suite``      the queries that are checked against SQL
"""
