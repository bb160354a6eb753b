"""K3 markdown export: one ``<root>/<domain>/<slug>.md`` file per document.

Executors write their own partition's files (``foreachPartition``) through
``pyarrow.fs``, which resolves local, HDFS and object-store URIs; nothing
passes through the driver. Writing the same document twice gives the same
file, so a retried task is harmless. Pass only added/updated documents to
keep unchanged files untouched, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _uri(root: str) -> str:
    if root.startswith("file:") and not root.startswith("file://"):
        return "file://" + root[len("file:"):]
    if root.startswith("/"):
        return "file://" + root
    return root


def export_markdown(docs: DataFrame, root: str) -> None:
    uri = _uri(root.rstrip("/"))

    def write(rows):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        made = set()
        for r in rows:
            folder = f"{base}/{r['domain']}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/{r['slug']}.md") as out:
                out.write(r["content"].encode("utf-8"))

    docs.select("domain", "slug", "content").foreachPartition(write)


def changed_docs(docs: DataFrame, diff: DataFrame) -> DataFrame:
    """Documents whose K2 status is added or updated."""
    changed = diff.where(F.col("status").isin("added", "updated")).select("domain", "slug")
    return docs.join(changed, ["domain", "slug"], "left_semi")
