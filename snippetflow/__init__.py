"""snippetflow: label code/text snippet tables and score the labels, on Spark.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
Column) and leaves the work to Spark executors.  Sub-packages:

* ``functions`` - Column builders (seeded uniforms, crops, prompts, cue scores)
* ``sources``   - parquet / CSV / JSON / model readers and writers
* ``operators`` - cleaning, sampling, labels, detection, classification,
                  ensembles, metrics, profiles
* ``plans``     - the train / eval / predict / profile jobs and the query catalog
* ``streaming`` - the per-row stages applied to a Structured Streaming source
"""

__version__ = "0.1.0"
