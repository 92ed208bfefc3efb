"""Reports of an analysis as text, CSV, JSON or HTML."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftmark import __version__
from weftmark.functions.text import fixed
from weftmark.options import RunInfo
from weftmark.plans.analysis import Analysis

TOOL = "Weftmark"
_NAMES = {"text": "text", "txt": "text", "csv": "csv", "json": "json", "html": "html", "htm": "html"}


def parse_format(name: str) -> str:
    if name.lower() not in _NAMES:
        raise ValueError(f"no report format {name!r}")
    return _NAMES[name.lower()]


def oneline(text: str, width: int = 80) -> str:
    flat = re.sub("[ \n\r\t]+", " ", text).encode()
    return flat.decode(errors="replace") if len(flat) <= width else flat[: max(width - 3, 0)].decode(errors="ignore") + "." * min(width, 3)


def _csv(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search('[,"\n\r]', text) else text


def severity(percent: float) -> str:
    return "hi" if percent >= 70 else "mid" if percent >= 30 else "lo"


def export(analysis: Analysis, path: str, fmt: str = "csv") -> None:
    """The matches as a CSV or JSON table of many files, written by the executors; for results too large for a report."""
    rows = analysis.named().select("rank", "file_a", "file_b", fixed(F.col("similarity")).alias("similarity_percent"), "shared_fingerprints")
    if fmt not in ("csv", "json"):
        raise ValueError(f"no table format {fmt!r}")
    rows.write.format(fmt).option("header", True).mode("errorifexists").save(path)


class Report:
    """What a report shows: the summary, the ranked matches and the fragments of the first ones.

    Only the summary and the fragments are kept; matches pass through the
    driver by partitions, in the order of their rank, as ``parts`` is read.
    """

    def __init__(self, analysis: Analysis, info: RunInfo = RunInfo(), first: int = 10):
        self.info, self.options, self.warnings, self.analysis, self.first = info, analysis.options, analysis.warnings, analysis, first
        self.summary = analysis.summary.first()
        self.fragments: dict[tuple, list] = {}
        if self.summary.matches_above_threshold:
            for f in analysis.fragments(first).orderBy("lhs", "rhs", "nth").collect():
                self.fragments.setdefault((f.lhs, f.rhs), []).append(f)

    def matches(self) -> Iterator[Row]:
        return self.analysis.named().orderBy("rank").toLocalIterator(prefetchPartitions=True)

    def parts(self, fmt: str) -> Iterator[str]:
        """The report in pieces."""
        return {"text": self.text, "csv": self.csv, "json": self.json, "html": self.html}[parse_format(fmt)]()

    def render(self, fmt: str) -> str:
        return "".join(self.parts(fmt))

    def text(self) -> Iterator[str]:
        s, o, i = self.summary, self.options, self.info
        head = f"{TOOL} Analysis Report"
        out = [head, "=" * len(head), "", f"Root:            {i.root}", f"Generated:       {i.timestamp}", f"Duration:        {i.duration_ms:.2f} ms", f"k-gram size:     {o.k}", f"Winnow window:   {o.window}"]
        out += [f"Threads:         {i.threads or '1 (sequential)'}", ""]
        out += ["Summary", "-------", f"Files:                  {s.files}", f"Comparisons:            {s.comparisons}", f"Highest similarity:     {s.highest:.2f}%", f"Average similarity:     {s.average:.2f}%"]
        out += [f"Matches (>= {o.threshold:.2f}%):       {s.matches_above_threshold}", f"Total fingerprints:     {s.total_fingerprints}", "", "Normalization", "-------------", f"Parentheses collapsed:  {s.parens_collapsed}", "", "Ranked Matches", "--------------"]
        yield "\n".join(out) + "\n"
        none = True
        for m in self.matches():
            if none:
                yield f"{'rank':<6}{'similarity':<13}{'file_a':<39}{'file_b':<39}shared\n"
            none = False
            yield f"{m.rank:>4}   {m.similarity:>8.2f}%   {m.file_a:<38}  {m.file_b:<38}  {m.shared_fingerprints:<6}\n"
        if none:
            yield "(no matches above threshold)\n"
        if self.warnings:
            yield "\n".join(["", "Warnings", "--------", *[f"- {w}" for w in self.warnings]]) + "\n"

    def csv(self) -> Iterator[str]:
        yield "rank,file_a,file_b,similarity_percent,shared_fingerprints\n"
        for m in self.matches():
            yield f"{m.rank},{_csv(m.file_a)},{_csv(m.file_b)},{m.similarity:.2f},{m.shared_fingerprints}\n"

    def json(self) -> Iterator[str]:
        s, o, i = self.summary, self.options, self.info
        two = lambda x: float(f"{x:.2f}")
        whole = {
            "tool": TOOL, "version": __version__, "root": i.root, "timestamp": i.timestamp, "duration_ms": two(i.duration_ms),
            "parameters": {"k": o.k, "window": o.window, "threads": i.threads, "threshold": two(o.threshold), "top_n": o.top_n},
            "summary": {"files": s.files, "comparisons": s.comparisons, "highest_similarity": two(s.highest), "average_similarity": two(s.average), "matches_above_threshold": s.matches_above_threshold, "total_fingerprints": s.total_fingerprints},
            "normalization": {"parens_collapsed": s.parens_collapsed}, "warnings": self.warnings,
        }
        yield json.dumps(whole, indent=2, ensure_ascii=False)[:-2] + ',\n  "matches": ['
        before = ""
        for m in self.matches():
            row = {"rank": m.rank, "file_a": m.file_a, "file_b": m.file_b, "similarity": two(m.similarity), "shared_fingerprints": m.shared_fingerprints}
            if m.rank <= self.first:
                row["fragments"] = [{k: f[k] for k in ("a_offset", "a_length", "a_text", "b_offset", "b_length", "b_text")} for f in self.fragments.get((m.lhs, m.rhs), [])]
            yield f"{before}\n    {json.dumps(row, ensure_ascii=False)}"
            before = ","
        yield ("\n  " if before else "") + "]\n}\n"

    def html(self) -> Iterator[str]:
        s, o, e = self.summary, self.options, html.escape
        card = lambda k, v: f'<div class="card"><b>{v}</b> {k}</div>'
        out = ["<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8">', f"<title>{TOOL} Report</title>", "<style>body{font-family:sans-serif;margin:2em}.card{display:inline-block;padding:.6em 1em;border:1px solid #ccc}td,th{padding:.3em .8em}.hi{color:#b00}.mid{color:#a70}.lo{color:#373}pre{background:#eee;padding:.4em}</style></head><body>"]
        out += [f"<h1>{TOOL} Report</h1>", f"<p>{e(self.info.root)} {e(self.info.timestamp)}, {self.info.duration_ms:.2f} ms, k={o.k}, w={o.window}</p>"]
        out += [card("files", s.files), card("comparisons", s.comparisons), card("highest", f'<span class="{severity(s.highest)}">{s.highest:.2f}%</span>'), card("average", f"{s.average:.2f}%"), card("matches", s.matches_above_threshold), card("parentheses collapsed", s.parens_collapsed)]
        out.append("<h2>Ranked Matches</h2><table><tr><th>#<th>similarity<th>file a<th>file b<th>shared</tr>")
        yield "\n".join(out) + "\n"
        detailed = []
        for m in self.matches():
            if m.rank <= self.first:
                detailed.append(m)
            yield f'<tr><td>{m.rank}<td class="{severity(m.similarity)}">{m.similarity:.2f}%<td>{e(m.file_a)}<td>{e(m.file_b)}<td>{m.shared_fingerprints}</tr>\n'
        out = ["</table>"]
        for m in detailed:
            if found := self.fragments.get((m.lhs, m.rhs)):
                out.append(f"<h3>#{m.rank} {e(m.file_a)} &harr; {e(m.file_b)}, {m.similarity:.2f}%</h3>")
                out += [f"<pre>{e(oneline(f.a_text))}\n{e(oneline(f.b_text))}</pre>" for f in found]
        if self.warnings:
            out.append("<h2>Warnings</h2><ul>" + "".join(f"<li>{e(w)}</li>" for w in self.warnings) + "</ul>")
        yield "\n".join([*out, "</body></html>"]) + "\n"
