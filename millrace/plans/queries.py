"""All queries of the engine and their SQL."""

from __future__ import annotations

from millrace.plans import curation, evaluation, records, storage

QUERIES = curation.QUERIES | evaluation.QUERIES | records.QUERIES | storage.QUERIES
ORACLE = curation.ORACLE | evaluation.ORACLE | records.ORACLE | storage.ORACLE
decontaminated_corpus = curation.decontaminated_corpus
