"""Digests that tell whether two runs read the same data."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame

from accordant.sources.readers import ROW, TableSource

FULL_BYTES, EDGE_BYTES = 512 << 20, 1 << 20


#: Files of a directory whose footers are read.
FOOTERS = 1000


def _footer(path: Path) -> dict:
    """Rows and columns by the file's own account, without reading its data."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    return {"rows": meta.num_rows, "columns": meta.num_columns}


def fingerprint_file(path: str | Path) -> dict:
    """SHA-256 of a file, or of its size and ends if it is large; Parquet files with rows and columns of their footers.

    Of a directory: names, sizes and footers, never the data, so a table of any size costs a listing. It is complete in
    that no part is left out; beyond ``FOOTERS`` parts, names and sizes alone are taken, and it is not.
    """
    path = Path(path)
    if path.is_dir():
        parts = sorted(path.rglob("*.parquet"))
        sizes, footers = [p.stat().st_size for p in parts], [_footer(p) for p in parts[:FOOTERS]]
        listing = [(str(p.relative_to(path)), n) for p, n in zip(parts, sizes)]
        known = {"rows": sum(f["rows"] for f in footers), "columns": max((f["columns"] for f in footers), default=0)} if len(parts) <= FOOTERS else {}
        return {"path": str(path), "bytes": sum(sizes), "sha256": hashlib.sha256(repr((listing, footers)).encode()).hexdigest(), "complete": len(parts) <= FOOTERS} | known
    size, digest = path.stat().st_size, hashlib.sha256()
    with path.open("rb") as f:
        if size <= FULL_BYTES:
            while block := f.read(1 << 20):
                digest.update(block)
        else:
            digest.update(str(size).encode() + f.read(EDGE_BYTES))
            f.seek(-EDGE_BYTES, 2)
            digest.update(f.read())
    return {"path": str(path), "bytes": size, "sha256": digest.hexdigest(), "complete": size <= FULL_BYTES} | (_footer(path) if path.suffix.lower() == ".parquet" else {})


def fingerprint_frame(df: DataFrame, facts: dict | None = None) -> dict:
    """Digest of the schema and of all rows in any order, in one pass or from the facts of one."""
    from accordant.operators.profile import side_facts

    facts = facts or side_facts(df)
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name != ROW]
    text = f"{schema}|{facts['rows']}|{facts['xor']}|{facts['sum']}"
    return {"rows": facts["rows"], "schema_sha256": hashlib.sha256(str(schema).encode()).hexdigest(), "sha256": hashlib.sha256(text.encode()).hexdigest()}


def fingerprint_source(source: TableSource, df: DataFrame, facts: dict | None = None) -> dict:
    return {"name": source.name, **(fingerprint_file(source.path) if source.path else fingerprint_frame(df, facts))}
