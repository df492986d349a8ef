"""What a reader should know of a run, each with its kind of evidence, and what to do about it."""

from __future__ import annotations

from accordant.operators.numerics import wilson


def number(x: float) -> str:
    """A figure as it is: whole numbers in full, others to at most six places."""
    return f"{x:.0f}" if x == int(x) else f"{x:.6f}".rstrip("0").rstrip(".")


_ORDER = {"critical": 0, "warning": 1, "info": 2}


def findings(summary: dict, schema: dict, keys: dict, columns: dict, analyses: dict, rules: list[dict], notes: list[dict], grain: dict) -> list[dict]:
    """All findings, the severe ones first; ids count within a category in the order in which they were made."""
    out: list[dict] = []

    def add(category: str, severity: str, evidence: str, title: str, todo: str | None = None, **details) -> None:
        n = 1 + sum(f["category"] == category for f in out)
        out.append({"id": f"{category}-{n}", "category": category, "severity": severity, "evidence": evidence, "title": title, "recommendation": todo, "details": details})

    for r in rules:
        if r["outcome"] in ("fail", "warning"):
            bound = f"at most {r['max']}" if r["max"] is not None else f"at least {r['min']}"
            add("rules", "critical" if r["outcome"] == "fail" else "warning", "rule", f"Rule {r['name']}: {r['metric']} is {number(r['value'])}, wanted {bound}", rule=r["name"])
    for side, other in (("right", "left"), ("left", "right")):
        if n := summary[f"missing_{side}"]:
            add("records", "warning", "observed", f"{n} records are missing on the {side}", f"Find out why records of the {other} table never reached the {side} one", count=n)
    if n := summary["value_mismatch_records"]:
        add("records", "warning", "observed", f"{n} records differ in {summary['value_mismatches']} values", count=n)
    for side in ("left", "right"):
        p = keys[side]
        if p["duplicate_keys"]:
            add("keys", "warning", "observed", f"{p['duplicate_keys']} keys have several rows on the {side}", "Choose keys that tell rows apart, or a duplicate strategy", side=side)
        if p["null_keys"]:
            add("keys", "warning", "observed", f"{p['null_keys']} rows on the {side} have no key", "Fill the keys: rows without one never match", side=side)
        for key, issues in p["format_issues"].items():
            for kind in ("blank", "whitespace", "case_variants", "malformed"):
                if issues.get(kind):
                    add("keys", "warning", "observed", f"Key {key} on the {side}: {issues[kind]} values with {kind.replace('_', ' ')}", f"Clean key {key}, or normalise it with key_normalize", side=side, key=key)
    if keys["relationship"] == "N:M":
        add("keys", "critical", "observed", "Keys have several rows on both sides: a join would multiply them", "Aggregate to the key, or add key columns", rows=keys["naive_join_rows"])
    elif keys["join_inflation"] > 0:
        add("keys", "warning", "observed", f"A join by key would make {keys['join_inflation']} extra rows", "Aggregate the finer side first", rows=keys["naive_join_rows"])
    for m in keys["type_mismatches"]:
        add("keys", "warning", "observed", f"Key {m['key']} is {m['left']} on the left and {m['right']} on the right", "Give both sides one type of key", **m)
    for d in keys["normalization_diagnosis"][:2]:
        add("keys", "warning", "likely", f"{d['resolved']} unmatched keys would match after {d['normalization']}", f"Set key_normalize: [{d['normalization']}]" if d["normalization"] != "alphanumeric_only" else "Bring keys to one format", **d)
    if grain["relationship"] in ("left_finer", "right_finer", "different"):
        add("grain", "info", "likely", f"The tables differ in grain: {', '.join(grain['left']['columns'])} and {', '.join(grain['right']['columns'])}", "Aggregate the finer table to the grain of the other", relationship=grain["relationship"])
    if (d := analyses.get("aggregation_diagnosis")) and d["columns"] and d["common_keys"]:
        if d["explained_by_grain"]:
            add("grain", "warning", "likely", "Totals per key agree: the differences come from grain", "Use duplicate_strategy: aggregate")
        else:
            add("grain", "info", "observed", "Totals per key differ as well")
    for c, s in columns.items():
        if s["datatype_mismatch"]:
            add("values", "warning" if s["failed"] else "info", "observed", f"Column {c} is {s['left_type']} on the left and {s['right_type']} on the right; {s['failed']} values can't be read", f"Give {c} one type", column=c)
        if s["mismatches"]:
            low, high = wilson(s["mismatches"], s["compared"])
            types = ", ".join(f"{v} {k}" for k, v in sorted(s["mismatch_types"].items()))
            add("values", "warning", "observed", f"Column {c}: {s['mismatches']} of {s['compared']} values differ ({types})", column=c, rate_ci95=[low, high], total_difference=s.get("totals", {}).get("difference"))
        elif s["within_tolerance"]:
            add("values", "info", "observed", f"Column {c}: {s['within_tolerance']} values agree only within the tolerance", column=c)
        for h in s["hints"]:
            if h["kind"] == "string_normalization":
                add("values", "warning", "likely", f"Column {c}: {h['would_resolve']} of {h['of']} differences vanish after {h['normalization']}", f"Set normalize on {c}: {h['normalization']}", column=c)
            elif h["kind"] == "constant_offset":
                add("values", "warning", "likely", f"Column {c}: {h['share']:.0%} of differences are {h['offset']}", f"Set timezone on {c}", column=c)
            elif h["kind"] == "precision":
                add("values", "info", "likely", f"Column {c}: {h['would_resolve']} differences vanish at the precision of a {h['unit']}", f"Set tolerance_seconds or compare_as_date on {c}", column=c)
            else:
                add("values", "warning", "observed", f"Column {c}: one side has a time zone, the other hasn't", f"Set timezone on {c}", column=c)
    for c, b in analyses.get("bias", {}).items():
        if b["systematic"]:
            kind = "by a constant share" if b["proportional"] else "by a constant amount" if b["constant_offset"] else "mostly to one side"
            add("bias", "warning", "statistical", f"Column {c} differs {kind}: {b['direction']} in {b['consistency']:.0%} of differences", f"Look for a rule that changes {c}: a rate, a fee or a rounding", column=c, p_value=b["p_value"])
    for c, d in analyses.get("distributions", {}).items():
        if d["shift"]:
            add("distribution", "info", "statistical", f"The distribution of {c} differs between the tables", column=c, p_value=d["p_value"])
    for name, d in analyses.get("concentration", {}).items():
        if d["concentrated"]:
            t = d["top"]
            add("concentration", "warning", "statistical", f"Problems gather at {name} = {t['level']}: {t['share_of_problems']:.0%} of problems in {t['share_of_records']:.0%} of records", f"Look at {name} = {t['level']} first", dimension=name, p_adjusted=d["p_adjusted"])
    for side, by in analyses.get("unmatched_population", {}).items():
        for name, d in by.items():
            if d["significant"] and d["over_represented"]:
                t = d["over_represented"][0]
                add("unmatched", "warning", "statistical", f"Records {side.replace('_', ' on the ')} gather at {name.lstrip('_')} = {t['level']}", f"Check whether {name.lstrip('_')} = {t['level']} is filtered out", dimension=name)
    for a in analyses.get("temporal", {}).get("anomalies", []):
        add("temporal", "warning", "statistical", f"{a['period']}: {a['rate']:.1%} problems against {a['baseline']:.1%} around it", f"Check the loads of {a['period']}", period=a["period"])
    for p in analyses.get("temporal", {}).get("change_points", []):
        add("temporal", "warning", "statistical", f"From {p['period']} on the problem rate is {p['rate_after']:.1%} instead of {p['rate_before']:.1%}", f"Look for a change on {p['period']}", period=p["period"])
    for t in analyses.get("control_totals", []):
        if t["difference"] and (t["relative"] is None or abs(t["relative"]) > 1e-9):
            add("totals", "info", "observed", f"Total of {t['measure']}: {number(t['left'])} on the left, {number(t['right'])} on the right", measure=t["measure"])
    for kind in ("added", "removed"):
        if schema[kind]:
            add("schema", "info", "observed", f"Columns {kind}: {', '.join(schema[kind])}", columns=schema[kind])
    for s in schema.get("suggestions", []):
        add("schema", "info", "likely", f"Column {s['left']} may be {s['right']} on the right", f"Set column_mapping: {{{s['left']}: {s['right']}}}", score=s["score"])
    for n in notes:
        if n["code"] == "ambiguous_set_aside":
            add("duplicates", "warning", "observed", n["message"], "Choose a duplicate strategy that compares them")
    return sorted(out, key=lambda f: _ORDER[f["severity"]])


def recommendations(found: list[dict]) -> list[str]:
    return list(dict.fromkeys(f["recommendation"] for f in found if f["recommendation"]))
