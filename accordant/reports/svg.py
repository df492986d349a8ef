"""Small inline charts."""

from __future__ import annotations

from html import escape

BLUE, RED, GREY = "#3b6ea5", "#b5493a", "#8a8f98"


def _svg(width: int, height: int, body: str, title: str) -> str:
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img" aria-label="{escape(title)}" font-family="sans-serif" font-size="11">{body}</svg>'


def bars(rows: list[tuple[str, float]], title: str = "", width: int = 560) -> str:
    """Horizontal bars with their values."""
    most = max([v for _, v in rows], default=0) or 1
    body = "".join(
        f'<text x="150" y="{16 + 20 * i}" text-anchor="end">{escape(str(n))[:24]}</text><rect x="156" y="{6 + 20 * i}" width="{max(1, (width - 230) * v / most):.1f}" height="14" fill="{BLUE}"/>'
        f'<text x="{162 + (width - 230) * v / most:.1f}" y="{17 + 20 * i}">{v:g}</text>'
        for i, (n, v) in enumerate(rows)
    )
    return _svg(width, 20 * len(rows) + 8, body, title)


def stacked(parts: list[tuple[str, float, str]], title: str = "", width: int = 560) -> str:
    """One bar of shares with a legend."""
    total, x, body = sum(v for _, v, _ in parts) or 1, 0.0, ""
    for i, (name, v, color) in enumerate(parts):
        w = width * v / total
        body += f'<rect x="{x:.1f}" y="0" width="{w:.1f}" height="22" fill="{color}"/><text x="{10 + i * width / len(parts):.0f}" y="40" fill="{color}">{escape(name)} {v:g}</text>'
        x += w
    return _svg(width, 46, body, title)


def histogram(rows: list[tuple[float, float, int]], title: str = "", width: int = 560, height: int = 140) -> str:
    most, step = max([n for *_, n in rows], default=0) or 1, width / max(len(rows), 1)
    body = "".join(f'<rect x="{i * step:.1f}" y="{height - 20 - (height - 30) * n / most:.1f}" width="{max(step - 1, 1):.1f}" height="{(height - 30) * n / most:.1f}" fill="{BLUE}"/>' for i, (_, _, n) in enumerate(rows))
    ends = f'<text x="0" y="{height - 4}">{rows[0][0]:.4g}</text><text x="{width}" y="{height - 4}" text-anchor="end">{rows[-1][1]:.4g}</text>' if rows else ""
    return _svg(width, height, body + ends, title)


def line(rows: list[tuple[str, float]], marks=(), title: str = "", width: int = 560, height: int = 140) -> str:
    """A line over periods; marked periods are dots."""
    most, n = max([v for _, v in rows], default=0) or 1, max(len(rows) - 1, 1)
    at = [(10 + (width - 20) * i / n, height - 22 - (height - 34) * v / most) for i, (_, v) in enumerate(rows)]
    body = f'<polyline fill="none" stroke="{BLUE}" stroke-width="1.5" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}"/>'
    body += "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="{RED}"/>' for (x, y), (p, _) in zip(at, rows) if p in marks)
    body += f'<text x="10" y="{height - 4}">{escape(rows[0][0])}</text><text x="{width - 10}" y="{height - 4}" text-anchor="end">{escape(rows[-1][0])}</text>' if rows else ""
    return _svg(width, height, body, title)
