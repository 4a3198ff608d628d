"""foliospark: analytics over collections of business documents, on Spark.

Modules:

* ``rules``      fixed rule tables (patterns, word lists, enums), passed as data
* ``session``    session settings and the shared checkpoint folder
* ``functions``  column functions: names, ids, timestamps, classifiers, templates
* ``operators``  DataFrame operators: folders, matching, search, reports, dedupe
* ``sources``    scans, sinks and sync planning
* ``plans``      event tables, idempotent load and the warehouse queries
* ``streaming``  Structured Streaming forms of the load and the counters
* ``catalog``    registered queries on the shared test tables, with their SQL
"""
