"""Frames of a few rows as HTML tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def table(rows: DataFrame, columns: dict[str, str], link: tuple[str, str] | None = None, most: int = 1000) -> str:
    """The ``columns`` of at most ``most`` rows under their titles, every value escaped; ``link`` names a column and the one with its address."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a page")
    out = ["<table border=1>", "<tr>" + "".join(f"<th>{escape(t)}</th>" for t in columns.values()) + "</tr>"]
    for row in found:
        cells = []
        for name in columns:
            shown = "" if row[name] is None else escape(str(row[name]))
            if link and name == link[0] and str(row[link[1]] or "").startswith(("http://", "https://")):
                shown = f'<a href="{escape(row[link[1]])}">{shown}</a>'
            cells.append(f"<td>{shown}</td>")
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "".join([*out, "</table>"])
