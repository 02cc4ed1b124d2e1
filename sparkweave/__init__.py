"""sparkweave: ingestion, refinement and governance operators on Spark DataFrames.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
leaves planning to Catalyst.  Sub-packages:

* ``sources``   readers (files, landed API responses, JDBC, object inventory)
* ``sinks``     writers (files, catalog tables, versioned path tables)
* ``functions`` Column-level helpers (masks, text cleaning, JSON decoding)
* ``operators`` DataFrame-level operators (refine, flatten, search, stats,
                upsert, id allocation, governance views)
* ``streaming`` file-backed topics, change-data-capture landing, monitors
* ``plans``     the end-to-end flows and the registered query catalogue
"""

__version__ = "0.1.0"
