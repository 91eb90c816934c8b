"""curata — a Spark-native content curation engine.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, aggregations and windows, so the same code serves batch jobs
and Structured Streaming micro-batches.

Sub-packages:

* ``curata.functions``  column expressions (URL / title canonicalisation, keyword
  patterns, tokeniser, sentence splitting, escaping, dates).
* ``curata.sources``    scans: driver tables, landed feeds, landed pages, the
  Parquet archive, and the item derivations used as test inputs.
* ``curata.operators``  relational operators: dedup, relevance, similarity,
  summarising, quality gate, publication views, run reports.
* ``curata.plans``      compositions of operators: discovery, generation,
  publication and the daily run.
* ``curata.streaming``  the Structured Streaming face of discovery.
"""

from curata.scope import Scope, Weights  # noqa: F401
from curata.session import get_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
