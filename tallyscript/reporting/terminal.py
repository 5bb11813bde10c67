"""Alignments and tables for a terminal, with ANSI colours."""

from __future__ import annotations

import shutil
from dataclasses import dataclass

from ..operators import align as A
from ..plans.registry import catalog


@dataclass(frozen=True)
class Ansi:
    match: str = ""
    substitution: str = "33"
    insertion: str = "36"
    deletion: str = "31"
    padding: str = "100"
    faint: str = "90"
    strong: str = "1"


def painted(text: str, code: str) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if code and text else text


def highlighted(text: str, spans: list[tuple[int, int]], code: str = "1;34") -> str:
    """A text with character spans in colour; spans that overlap are one."""
    out, at = [], 0
    for s, e in sorted(spans):
        s = max(s, at)
        if s < e:
            out += (text[at:s], painted(text[s:e], code))
            at = e
    return "".join(out) + text[at:]


def alignment_text(ops: list[dict], max_line_length: int | float = 0.5, title: str | None = None, colors: Ansi = Ansi()) -> str:
    """The alignment in numbered pairs of lines; a fraction is one of the terminal's width."""
    if isinstance(max_line_length, float):
        if not 0 < max_line_length <= 1:
            raise ValueError("max_line_length as a float must be a fraction in (0, 1]")
        max_line_length = round(shutil.get_terminal_size().columns * max_line_length)
    prefix = len("   1  Ref.  ")
    most = max_line_length - prefix
    kinds = {A.MATCH: colors.match, A.SUBSTITUTE: colors.substitution, A.INSERT: colors.insertion, A.DELETE: colors.deletion}
    lines: list[list[list[str]]] = [[[], []]]
    length = prefix
    for op in ops:
        n = max(len(x) for x in (op["ref"], op["hyp"]) if x is not None)
        if length + n > most:
            lines.append([[], []])
            length = prefix
        for side, text in zip(lines[-1], (op["ref"], op["hyp"]), strict=True):
            side.append(painted(text or "", kinds[op["type"]]) + painted(" " * (n - len(text or "")), colors.padding))
        lines[-1][0].append(" ")
        lines[-1][1].append(painted(" ", colors.padding) if op["hyp_rp"] else " ")
        length += n + 1
    out = [painted(title, f"{colors.strong};{colors.faint}"), ""] if title else []
    for i, (ref, hyp) in enumerate(lines, 1):
        out += (painted(f"{i:>4}  Ref.  ", colors.faint) + "".join(ref).rstrip(), painted("      Hyp.  ", colors.faint) + "".join(hyp).rstrip())
        if i < len(lines):
            out.append("")
    return "\n".join(out)


def metric_table() -> str:
    """All registered metrics with their values."""
    head = ("name", "short", "long", "main", "other", "example main", "example other")
    rows = [head, *catalog()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
