"""pagewise — content analytics (clean text, readability, SEO, quality,
similarity, model-output parsing, usage metering) as Spark DataFrame jobs.

Layout:
  functions/  Column -> Column expressions (text, URL, HTML, readability, quality)
  operators/  DataFrame -> DataFrame jobs (records, term frequencies, joins, metering)
  sources/    table readers with declared schemas and derived fixtures
  plans/      the registered query catalogue and its SQL oracles
  streaming/  Structured Streaming forms of the batch jobs
"""

from pagewise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
