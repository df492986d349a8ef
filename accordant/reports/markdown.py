"""A result document as Markdown, and in a few lines for the terminal."""

from __future__ import annotations


def _cell(x) -> str:
    text = "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return text.replace("|", "\\|").replace("\n", " ")


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "None.\n"
    columns = columns or list(rows[0])
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def sections(d: dict) -> list[tuple[str, str, list[dict] | str]]:
    """All parts of a report: anchor, title, and rows or text. Both reports are made from these."""
    s, a = d["summary"], d["analyses"]
    figures = [{"figure": k.replace("_", " "), "value": v} for k, v in s.items() if not isinstance(v, list)]
    out: list = [("summary", "Summary", figures), ("findings", "Findings", [{"id": f["id"], "severity": f["severity"], "evidence": f["evidence"], "finding": f["title"]} for f in d["findings"]])]
    out.append(("recommendations", "Recommendations", [{"recommendation": r} for r in d["recommendations"]]))
    out.append(("rules", "Rules", [{k: r[k] for k in ("name", "outcome", "metric", "column", "value", "max", "min")} for r in d["rules"]]))
    out.append(("columns", "Columns", [{k: c[k] for k in ("column", "kind", "compared", "matches", "mismatches", "within_tolerance", "mismatch_percentage", "classification")} for c in d["columns"].values()]))
    out.append(("schema", "Schema", [{"change": k, "columns": ", ".join(d["schema"][k])} for k in ("added", "removed") if d["schema"][k]] + [{"change": "type", "columns": f"{c['column']}: {c['left']} / {c['right']}"} for c in d["schema"]["dtype_changes"]]))
    out.append(("keys", "Keys", [{"side": x, **{k: d["keys"][x][k] for k in ("rows", "unique_keys", "duplicate_keys", "null_keys", "max_rows")}} for x in ("left", "right")] + [{"side": f"relationship {d['keys']['relationship']}", "rows": d["keys"]["naive_join_rows"]}]))
    out.append(("totals", "Control totals", a.get("control_totals", [])))
    out.append(("grain", "Grain", [{"side": x, "columns": ", ".join(a["grain"][x]["columns"]), "rows": a["grain"][x]["rows"]} for x in ("left", "right")] if "grain" in a else []))
    out.append(("bias", "Bias", [{"column": c, **{k: b.get(k) for k in ("pairs", "direction", "consistency", "p_value", "systematic")}} for c, b in a.get("bias", {}).items()]))
    out.append(("distributions", "Distributions", [{"column": c, "kind": x["kind"], "p_value": x.get("p_value"), "shift": x["shift"]} for c, x in a.get("distributions", {}).items()]))
    out.append(("concentration", "Concentration", [{"dimension": n, "top level": x["top"]["level"], "lift": x["top"]["lift"], "p_adjusted": x["p_adjusted"], "concentrated": x["concentrated"]} for n, x in a.get("concentration", {}).items()]))
    out.append(("unmatched", "Missing population", [{"side": side, "dimension": n, "p_adjusted": x["p_adjusted"], "significant": x["significant"]} for side, by in a.get("unmatched_population", {}).items() for n, x in by.items()]))
    out.append(("temporal", "Over time", [{"period": p["period"], "problems": p["problems"], "records": p["records"], "rate": p["rate"]} for p in a.get("temporal", {}).get("periods", [])]))
    out.append(("largest", "Largest differences", [{"column": c, **{k: r.get(k) for k in ("left_value", "right_value", "difference")}} for c, rows in a.get("largest_differences", {}).items() for r in rows]))
    out.append(("samples", "Differing values", d["records"]["value_mismatch_sample"]))
    out.append(("metadata", "Run", [{"item": k, "value": str(v)} for k, v in d["metadata"].items()]))
    return out


def render(d: dict) -> str:
    parts = [f"# {d['name']}: {d['status']}\n"]
    for _, title, rows in sections(d):
        parts.append(f"## {title}\n\n{table(rows)}")
    return "\n".join(parts)


def summary_text(d: dict) -> str:
    s = d["summary"]
    lines = [f"{d['name']}: {d['status']}", f"  records   {s['total_records']} ({s['match_percentage']:.2f} % match)", f"  differ    {s['value_mismatch_records']} records, {s['value_mismatches']} values"]
    lines += [f"  missing   {s['missing_left']} left, {s['missing_right']} right", f"  set aside {s['ambiguous_records']}"] + [f"  [{f['severity']}] {f['title']}" for f in d["findings"][:10]]
    return "\n".join(lines)
