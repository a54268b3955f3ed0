"""Renderings of stats rows: TSV, JSON and a table."""

from __future__ import annotations

import json

from ..operators.stats import COLUMNS

BASIC = ("file", "format", "seq_type", "records", "total_bases", "min_len", "max_len", "mean_len", "gc_pct", "n50")
TITLES = {"seq_type": "type"}
LENGTHS = ("n50", "l50")
QUALITIES = ("q10_pct", "q20_pct", "q30_pct")
READS = ("fastq", "sam", "bam", "cram")


def all_columns(rows: list[dict]) -> list[str]:
    """Without N50 and L50 where no file is FASTA, without quality percentages where none has qualities."""
    fasta, reads = any(r["format"] == "fasta" for r in rows), any(r["format"] in READS for r in rows)
    return [c for c in COLUMNS if (c not in LENGTHS or fasta) and (c not in QUALITIES or reads)]


def applies(row: dict, column: str) -> bool:
    if row["format"] == "mixed":
        return row[column] is not None
    if column in LENGTHS:
        return row["format"] == "fasta"
    return column not in QUALITIES or (row["format"] in READS and row[column] is not None)


def tsv(rows: list[dict], every: bool = False) -> str:
    columns = all_columns(rows) if every else list(BASIC)

    def cell(r: dict, c: str) -> str:
        v = r[c]
        if every and not applies(r, c):
            return "NA"
        if every and c in LENGTHS:
            return f"{v:,}"
        if every and c in QUALITIES:
            return f"{v:.2f}%"
        return f"{v:.3f}" if isinstance(v, float) else "NA" if v is None else str(v)

    lines = ["\t".join(TITLES.get(c, c) for c in columns)]
    return "\n".join(lines + ["\t".join(cell(r, c) for c in columns) for r in rows]) + "\n"


def as_json(rows: list[dict]) -> str:
    return json.dumps([{c: r[c] for c in COLUMNS} for r in rows], indent=2) + "\n"


def table(rows: list[dict], total: dict | None = None, every: bool = False) -> str:
    """Aligned columns, with separators of thousands and percent signs, and the TOTAL row where it is given."""
    columns = all_columns(rows) if every else list(BASIC)
    shown = [*rows, total] if total else rows

    def cell(r: dict, c: str) -> str:
        v = r[c]
        if v is None or (every and not applies(r, c)):
            return "NA"
        if c.endswith("_pct"):
            return f"{v:.2f}%"
        return f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else v

    cells = [[TITLES.get(c, c) for c in columns], *([cell(r, c) for c in columns] for r in shown)]
    wide = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    left = {"file", "format", "seq_type"}
    return "".join("  ".join(x.ljust(w) if c in left else x.rjust(w) for x, w, c in zip(row, wide, columns, strict=True)).rstrip() + "\n" for row in cells)
