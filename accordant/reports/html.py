"""A result document as one HTML page without outside resources."""

from __future__ import annotations

from html import escape

from accordant.reports import svg
from accordant.reports.markdown import sections

_STYLE = "body{font:14px/1.5 sans-serif;max-width:1000px;margin:2em auto;color:#222}table{border-collapse:collapse;margin:.5em 0}td,th{border-bottom:1px solid #ddd;padding:3px 9px;text-align:left}.PASS{color:#2c7a3f}.FAIL{color:#b5493a}.PASS_WITH_WARNINGS{color:#a8720d}nav a{margin-right:1em}"


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>None.</p>"
    columns = list(dict.fromkeys(k for r in rows for k in r))
    head = "".join(f"<th>{escape(str(c))}</th>" for c in columns)
    text = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{escape(text(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def _charts(d: dict) -> dict[str, str]:
    s, a = d["summary"], d["analyses"]
    out = {"summary": svg.stacked([("matched", s["matched_records"], "#2c7a3f"), ("differ", s["value_mismatch_records"], svg.RED), ("missing left", s["missing_left"], svg.GREY), ("missing right", s["missing_right"], svg.BLUE)], "records by status")}
    wrong = [(c["column"], c["mismatches"]) for c in d["columns"].values() if c["mismatches"]]
    if wrong:
        out["columns"] = svg.bars(wrong, "differing values by column")
    t = a.get("temporal", {})
    if t.get("periods"):
        out["temporal"] = svg.line([(p["period"], p["rate"]) for p in t["periods"]], {x["period"] for x in t["anomalies"]}, "problem rate by period")
    return out


def render(d: dict) -> str:
    charts, body = _charts(d), []
    links = "".join(f'<a href="#{k}">{escape(t)}</a>' for k, t, _ in sections(d))
    for key, title, rows in sections(d):
        body.append(f'<section id="{key}"><h2>{escape(title)}</h2>{charts.get(key, "")}{_table(rows)}</section>')
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(d["name"])}</title><style>{_STYLE}</style></head><body><h1>{escape(d["name"])} <span class="{d["status"]}">{d["status"]}</span></h1><nav>{links}</nav>{"".join(body)}</body></html>'
