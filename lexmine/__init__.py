"""lexmine: vocabulary mining on Spark.

Entry points:

* ``lexmine.plans.queries.REGISTRY`` - every registered query, ``fn(spark, sf_dir) -> DataFrame``
  (also exposed through ``__spark_entry__.queries()``).
* ``lexmine.plans.jobs`` - end-to-end jobs on a store folder: ``collect``, ``export_notes``, ``notify``.
* ``lexmine.operators`` - the building blocks (extraction, word bank, collection run, rendering,
  remote-extractor tables), ``lexmine.sources`` (landed inputs), ``lexmine.streaming`` (Structured
  Streaming forms), ``lexmine.sinks`` (note files), ``lexmine.functions`` (column expressions).
"""
