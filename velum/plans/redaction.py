"""Detection to redacted text, and a batch of files to history, each one lazy chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.operators import detect as D
from velum.operators import history as H
from velum.operators import redact as R
from velum.operators import review as V
from velum.operators.model_layer import Model, contextual
from velum.sources.documents import PageReader, extract


def detect(docs: DataFrame, model: Model | None = None, tagger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of every document: rules, then the contextual layer if there is one, merged, and one row per entity."""
    layer = contextual(docs, model, tagger, key, text) if model or tagger is not None else None
    return D.candidates(D.findings(docs, model=layer, key=key, text=text), key)


def redact_documents(docs: DataFrame, edits: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, redacted, n_replaced_candidates) of every document, after reviewers' edits if given.

    Without edits a text is scanned and redacted in its own row; edits are a table of candidates' changes, so candidates become rows.
    """
    if edits is None:
        return R.redact_found(docs, *D.spans_of(docs, text=text), key=key, text=text)
    return R.redact(docs, V.apply_edits(detect(docs, key=key, text=text), edits, key), key=key, text=text)


def scan_files(files: DataFrame, history: DataFrame, page_reader: PageReader | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, duplicates) of incoming files (path, content): what the history knows by its bytes isn't read again."""
    hashed = files.withColumn("file_hash", H.fingerprint(F.col("content")))
    return extract(H.unseen(hashed, history).select("path", "content"), page_reader), H.duplicates(hashed.drop("content"), history)
