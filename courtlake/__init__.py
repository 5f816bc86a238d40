"""Courtlake: box-score analytics expressed as Spark DataFrame jobs.

Layers
------
``functions``  column expressions (casts, ratios, calendar, box-score metrics)
``operators``  generic DataFrame -> DataFrame operators, safe under key skew
``sources``    readers, writers and the table layout
``plans``      the domain datasets: staging, marts, ratings, features, reports
``streaming``  incremental load of the daily document drop
"""
