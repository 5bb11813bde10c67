"""HTML reports: summary, metrics, and each example's alignment with its key terms marked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from html import escape
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import align as A
from ..plans.config import PipelineKey
from ..plans.evaluation import EvalSet
from ..sources.writers import target


@dataclass(frozen=True)
class Colors:
    padding: str = "#eceff1"
    deletion: str = "#c62828"
    insertion: str = "#00838f"
    substitution: str = "#b26a00"
    match: str = "#263238"
    key_term: str = "#1565c0"


@dataclass(frozen=True)
class Labels:
    ref: str = "Ref."
    hyp: str = "Hyp."
    match: str = "Match"
    substitution: str = "Substitution"
    insertion: str = "Insertion"
    deletion: str = "Deletion"
    padding: str = "Padding"
    key_term: str = "Key term"
    tooltips: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MetricItem:
    """A metric of the report: its name, a label, a format, and its arguments."""

    name: str
    label: str | None = None
    format: str = ".2%"
    arguments: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class SummaryItem:
    name: str
    label: str | None = None
    format: str = ",.0f"


@dataclass(frozen=True)
class AlignmentItem:
    name: str = "levenshtein"
    arguments: tuple[tuple[str, object], ...] = ()


METRIC_ITEMS = (MetricItem("wer"), MetricItem("cer"), MetricItem("legacy_medical_word_accuracy", "Medical Term Recall"))
SUMMARY_ITEMS = (
    SummaryItem("num_examples", "Number of examples"),
    SummaryItem("num_ref_words", "Number of reference words"),
    SummaryItem("num_ref_chars", "Number of reference characters"),
    SummaryItem("num_hyp_words", "Number of hypothesis words"),
    SummaryItem("num_hyp_chars", "Number of hypothesis characters"),
)
_COLOR = {A.MATCH: "match", A.SUBSTITUTE: "substitution", A.INSERT: "insertion", A.DELETE: "deletion"}


def padding(n: int, colors: Colors) -> str:
    return f'<span style="background-color: {colors.padding};">{"&nbsp;" * n}</span>'


def op_cells(op: dict, colors: Colors) -> tuple[str, str, int]:
    """An operation's two cells, padded to the same width, and that width."""
    color = getattr(colors, _COLOR[op["type"]])
    sides = [op["ref"], op["hyp"]]
    width = max(len(s) for s in sides if s is not None)
    cells = []
    for s in sides:
        if s is None:
            cells.append(padding(width, colors))
        else:
            cells.append(f'<span style="color: {color};">{escape(s)}</span>' + (padding(width - len(s), colors) if len(s) < width else ""))
    return cells[0], cells[1], width


def marked(cell: str, start: bool = False, end: bool = False) -> str:
    return f'<span class="kw{" kw-start" * start}{" kw-end" * end}">{cell}</span>'


def html_lines(ops: list[dict], spans: list[tuple[int, int]] = (), width: int = 100, colors: Colors = Colors()) -> list[tuple[str, str]]:
    """The alignment in lines of at most `width` characters (longer only for a single longer operation): pairs of HTML.

    `spans` are key terms as token spans of the reference.
    """
    place = {o["ref_idx"]: i for i, o in enumerate(ops) if o["ref_idx"] is not None}
    starts, ends, inside = set(), set(), set()
    for s, e in spans:
        if s in place and e - 1 in place:
            starts.add(place[s])
            ends.add(place[e - 1])
            inside.update(range(place[s], place[e - 1]))
    lines, ref, hyp, length = [], [], [], 0
    for i, op in enumerate(ops):
        a, b, n = op_cells(op, colors)
        if i in starts or i in ends or i in inside:
            a = marked(a, i in starts, i in ends)
        if length and length + n > width:
            lines.append(("".join(ref), "".join(hyp)))
            ref, hyp, length = [], [], 0
        ref += (a, marked("&nbsp;") if i in inside else "&nbsp;")
        hyp += (b, padding(1, colors) if op["hyp_rp"] else "&nbsp;")
        length += n + 1
    return [*lines, ("".join(ref), "".join(hyp))]


def line_column(ops: Column, spans: Column, width: int = 100, colors: Colors = Colors()) -> Column:
    """html_lines as a column, array<struct<ref, hyp>>."""
    from pyspark.sql.pandas.functions import arrow_udf

    kind = pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string())]))

    @arrow_udf("array<struct<ref:string,hyp:string>>")
    def lines(o: pa.Array, s: pa.Array) -> pa.Array:
        made = [html_lines(x or [], [(t["s"], t["e"]) for t in y or []], width, colors) for x, y in zip(o.to_pylist(), s.to_pylist(), strict=True)]
        return pa.array([[{"ref": a, "hyp": b} for a, b in row] for row in made], kind)

    return lines(ops, spans)


def rendered(data: EvalSet, alignment: AlignmentItem = AlignmentItem(), *, width: int = 100, colors: Colors = Colors(), allow_subset_matches: bool = False) -> DataFrame:
    """(ex_id, lines) of every example. Key terms are those of all vocabularies under the default pipeline."""
    ops = data.metrics.get(alignment.name, **dict(alignment.arguments)).examples().select("ex_id", F.col("alignment").alias("ops"))
    key = PipelineKey()
    found = None
    for name in sorted(data.names):
        m = data.key_term_matches(name, key, allow_subset_matches=allow_subset_matches).where("side = 'ref'").select("ex_id", "s", "e")
        found = m if found is None else found.unionByName(m)
    kind = "array<struct<s:int,e:int>>"
    if found is None:
        return ops.select("ex_id", line_column(F.col("ops"), F.array().cast(kind), width, colors).alias("lines"))
    spans = found.groupBy("ex_id").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).cast(kind).alias("spans"))
    return ops.join(spans, "ex_id", "left").select("ex_id", line_column(F.col("ops"), F.col("spans"), width, colors).alias("lines"))


def _table(title: str, rows: list[tuple[str, str]]) -> str:
    body = "".join(f"<tr><td>{escape(k)}</td><td>{escape(v)}</td></tr>" for k, v in rows)
    return f"<section><h2>{escape(title)}</h2><table>{body}</table></section>"


def _legend(colors: Colors, labels: Labels) -> str:
    items = []
    for name in ("match", "substitution", "insertion", "deletion", "padding", "key_term"):
        tip = labels.tooltips.get(name)
        style = f"background-color: {colors.padding}" if name == "padding" else f"color: {getattr(colors, name)}"
        items.append(f'<span style="{style};"{f" title={escape(tip)!r}" if tip else ""}>{escape(getattr(labels, name))}</span>')
    return f'<p class="legend">{" ".join(items)}</p>'


def _shown(value, spec: str) -> str:
    return "-" if value is None else format(value, spec)


def pieces(data: EvalSet, *, title: str = "Evaluation report", metrics: tuple[MetricItem, ...] = METRIC_ITEMS, summary: tuple[SummaryItem, ...] = SUMMARY_ITEMS, alignment: AlignmentItem = AlignmentItem(), colors: Colors = Colors(), labels: Labels = Labels(), width: int = 100) -> Iterator[str]:
    """The report's HTML piece by piece: the examples pass through the driver one at a time, in the order of ex_id."""
    css = f"body{{font-family:sans-serif;margin:2em}}.line{{font-family:monospace;white-space:nowrap}}.kw{{border-bottom:2px solid {colors.key_term}}}td{{padding:0 1em}}"
    yield f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{css}</style></head><body><h1>{escape(title)}</h1><p>{date.today():%B %d, %Y}</p>'
    totals = data.metrics.get("summary").all_values()
    yield _table("Summary", [(i.label or i.name, _shown(totals[i.name], i.format)) for i in summary])
    made = [(i, data.metrics.get(i.name, **dict(i.arguments))) for i in metrics]
    yield _table("Metrics", [(i.label or m.long_name, _shown(m.value, i.format)) for i, m in made])
    yield _legend(colors, labels)
    for row in rendered(data, alignment, width=width, colors=colors).orderBy("ex_id").toLocalIterator():
        lines = "".join(f'<div class="line">{escape(labels.ref)}&nbsp;{x["ref"]}</div><div class="line">{escape(labels.hyp)}&nbsp;{x["hyp"]}</div>' for x in row["lines"])
        yield f'<article><h3>{row["ex_id"]}</h3>{lines}</article>'
    yield "</body></html>\n"


def render(data: EvalSet, **options) -> str:
    return "".join(pieces(data, **options))


def write(data: EvalSet, path: str | Path, allow_overwrite: bool = False, **options) -> None:
    with target(path, allow_overwrite).open("w", encoding="utf-8") as f:
        f.writelines(pieces(data, **options))
