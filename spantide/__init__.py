"""spantide: span and term annotation of document corpora as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame``. Annotation tables carry
``doc_id`` plus half-open code-point offsets ``[begin, end)`` into the document text.
"""

from spantide.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
