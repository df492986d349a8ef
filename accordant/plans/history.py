"""Past runs in a small SQLite file."""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing
from pathlib import Path

COLUMNS = ("run_id", "name", "status", "started_at", "finished_at", "config_hash", "git_commit", "left_rows", "right_rows", "matched_records", "value_mismatch_records", "missing_records", "match_percentage", "document")


class HistoryStore:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with closing(self._open()) as db, db:
            db.execute(f"CREATE TABLE IF NOT EXISTS runs ({', '.join(c + (' TEXT PRIMARY KEY' if c == 'run_id' else '') for c in COLUMNS)})")

    def _open(self) -> sqlite3.Connection:
        db = sqlite3.connect(self.path)
        db.row_factory = sqlite3.Row
        return db

    def record(self, result) -> str:
        d = result.to_dict()
        row = {**d["metadata"], **d["summary"], "name": d["name"], "status": d["status"], "document": json.dumps(d, allow_nan=False)}
        with closing(self._open()) as db, db:
            db.execute(f"INSERT OR REPLACE INTO runs VALUES ({', '.join('?' * len(COLUMNS))})", [row.get(c) for c in COLUMNS])
        return row["run_id"]

    def runs(self, name: str | None = None, limit: int = 50) -> list[dict]:
        """Runs, the latest first, without their documents."""
        some = ", ".join(c for c in COLUMNS if c != "document")
        with closing(self._open()) as db:
            got = db.execute(f"SELECT {some} FROM runs WHERE ? IS NULL OR name = ? ORDER BY started_at DESC, rowid DESC LIMIT ?", (name, name, limit))
            return [dict(r) for r in got]

    def get(self, run_id: str) -> dict | None:
        """The document of a run; a prefix of its id is enough if it is the only one."""
        with closing(self._open()) as db:
            got = db.execute("SELECT document FROM runs WHERE substr(run_id, 1, ?) = ? LIMIT 2", (len(run_id), run_id)).fetchall()
        return json.loads(got[0]["document"]) if len(got) == 1 else None

    def previous(self, run_id: str) -> dict | None:
        """The document of the run of the same name before this one."""
        with closing(self._open()) as db:
            got = db.execute("SELECT p.document FROM runs r JOIN runs p ON p.name = r.name AND p.started_at < r.started_at WHERE r.run_id = ? ORDER BY p.started_at DESC LIMIT 1", (run_id,)).fetchone()
        return json.loads(got["document"]) if got else None
