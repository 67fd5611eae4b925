"""docloom: documentation corpora as Spark relations.

Scan trees of Markdown or HTML, extract metadata and structure, derive the page
hierarchy, resolve cross-references and plan the reconciliation with a
published snapshot.  Every operator maps DataFrames to DataFrames.
"""
