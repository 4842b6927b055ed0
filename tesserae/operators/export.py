"""Sinks and reports: CSV, JSON, bundles, provenance, Markdown, HTML and LaTeX tables."""

from __future__ import annotations

import html
import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources import xlsx


def flat(df: DataFrame, sep: str = "|") -> DataFrame:
    """Lists joined, timestamps as UTC text, maps and structs as JSON: what CSV can hold."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array<string"):
            c = F.array_join(c, sep)
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


#: Passed on to Hadoop's codecs: packing by the fastest level.
FAST = {"zlib.compress.level": "BEST_SPEED"}


def write_csv(df: DataFrame, path: str, bom: bool = True, sep: str = ",", encoding: str = "UTF-8", compression: str = "none") -> None:
    """CSV files with a header, distributed; a byte order mark leads the first column's name if wanted.

    Space around values is kept, and quotes are doubled, so reading gives the same values back.
    """
    made = flat(df)
    if bom and made.columns:
        made = made.withColumnRenamed(made.columns[0], "﻿" + made.columns[0])
    made.write.options(**FAST).csv(path, header=True, sep=sep, encoding=encoding, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression=compression)


def write_xlsx(df: DataFrame, path: str, mode: str = "append") -> None:
    """Spreadsheets with a header, one or more per task; lists are joined as in CSV."""
    xlsx.write(flat(df), path, mode)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.options(**FAST).json(path, ignoreNullFields=False, compression=compression)


def export_rows(corpus: DataFrame, tags: DataFrame, categories: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The corpus with its joined tags, the surest classifier tag, and the topic's name."""
    from tesserae.operators.coding import attach_tags

    human, machine = tags.where("coder <> 'ai'"), tags.where("coder = 'ai'")
    out = attach_tags(corpus, human, categories)
    best = machine.groupBy("_row_idx").agg(F.max_by("cat_id", F.struct("confidence", "cat_id")).alias("ai_tag"), F.max("confidence").alias("ai_confidence"))
    out = out.join(best, "_row_idx", "left").withColumn("ai_tag", F.coalesce("ai_tag", F.lit("")))
    return out.join(topics.select("_row_idx", F.col("name").alias("topic")), "_row_idx", "left") if topics is not None else out


def export_counts(corpus: DataFrame, tags: DataFrame, memos: DataFrame | None = None, topics: DataFrame | None = None, spans: DataFrame | None = None) -> dict[str, int]:
    """What an export would hold: rows, tags by hand and by classifier, memos, topics and spans."""
    n = corpus.count()
    ai = F.col("coder") == "ai"
    by = tags.agg(F.count_distinct(F.when(ai, F.col("_row_idx"))), F.count_distinct(F.when(~ai, F.col("_row_idx")))).first()
    size = lambda df: df.count() if df is not None else 0
    more = {"ai_rows": by[0], "hand_rows": by[1], "topic_rows": size(topics), "spans": size(spans)}
    told = tags.agg(F.countDistinct("_row_idx"), F.count("*"), F.countDistinct("coder"), F.countDistinct("cat_id")).first()
    return {"rows": n, "tagged": told[0], "untagged": n - told[0], "tags": told[1], "coders": told[2], "categories": told[3], "memos": size(memos)} | more


def bundle(parts: dict[str, str | bytes], readme: str) -> bytes:
    """A ZIP of named, already rendered parts and a README."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {**parts, "README.txt": readme}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def provenance_markdown(entries: list[dict]) -> str:
    lines = ["# Provenance", ""]
    for e in entries:
        params = json.loads(e["params"]) if isinstance(e["params"], str) else e["params"]
        lines.append(f"- {e['ts']} **{e['action']}** " + ", ".join(f"{k}={v}" for k, v in sorted(params.items())))
    return "\n".join(lines) + "\n"


def markdown_table(rows: list[dict], digits: int = 3) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [" | ".join(names), " | ".join("---" for _ in names), *(" | ".join(shown(r[n]) for n in names) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def report(title: str, sections: dict[str, str | list[dict]], as_html: bool = False) -> str:
    """A report of texts and tables in Markdown, or as one HTML page."""
    if not as_html:
        return "\n".join([f"# {title}", "", *(f"## {name}\n\n{body if isinstance(body, str) else markdown_table(body)}" for name, body in sections.items())])
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, body in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(body, str):
            out.append(f"<p>{html.escape(body)}</p>")
        elif body:
            cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
            out.append("<table>" + cells("th", body[0]) + "".join(cells("td", r.values()) for r in body) + "</table>")
    return "".join([*out, "</body></html>"])


_LATEX = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def latex_escape(text: str) -> str:
    """All special characters in one pass, so no replacement is replaced again."""
    return str(text).translate(_LATEX)


def latex_table(rows: list[dict], caption: str, label: str, digits: int = 2) -> str:
    names = list(rows[0]) if rows else []
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else latex_escape(v)
    body = [" & ".join(map(latex_escape, names)) + r" \\ \midrule", *(" & ".join(shown(r[n]) for n in names) + r" \\" for r in rows)]
    return "\n".join([r"\begin{table}[ht]\centering", rf"\caption{{{latex_escape(caption)}}}\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(names)}}}\toprule", *body, r"\bottomrule\end{tabular}", r"\end{table}"])


def apa_table(rows: list[dict], number: int, title: str, digits: int = 2) -> str:
    return f"**Table {number}**\n\n*{title}*\n\n{markdown_table(rows, digits)}"
