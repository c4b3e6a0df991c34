"""Report tables from small results: Markdown and LaTeX, formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report table may have.
MOST_ROWS = 500


def number(x, digits: int = 4) -> str:
    if x is None:
        return "—"
    if isinstance(x, float) and x and abs(x) < 1e-4:
        return f"{x:.2e}"
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def p_value(p: float | None) -> str:
    return "—" if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def tex(text: str) -> str:
    for a, b in (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("_", r"\_"), ("#", r"\#"), ("$", r"\$")):
        text = text.replace(a, b)
    return text


def bold_max(values: list[float | None], latex: bool = False) -> list[str]:
    """Formatted values, the greatest one bold if it is alone."""
    known = [v for v in values if v is not None]
    top = max(known, default=None)
    alone = known.count(top) == 1
    mark = (lambda s: rf"\textbf{{{s}}}") if latex else (lambda s: f"**{s}**")
    return [mark(number(v)) if alone and v == top else number(v) for v in values]


def _few_rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report table")
    return rows


def latex(df: DataFrame, caption: str | None = None) -> str:
    """A LaTeX table of a small result, numbers to the right."""
    rows = _few_rows(df)
    line = lambda cells: " & ".join(cells) + r" \\"
    spec = "".join("r" if kind in ("int", "bigint", "double", "float") else "l" for _, kind in df.dtypes)
    body = [r"\begin{tabular}{" + spec + "}", r"\hline", line([tex(c) for c in df.columns]), r"\hline", *[line([tex(number(x)) for x in r]) for r in rows], r"\hline", r"\end{tabular}"]
    return "\n".join([*([r"\caption{" + tex(caption) + "}"] if caption else []), *body]) + "\n"


def markdown(df: DataFrame) -> str:
    """A Markdown table of a small result; larger ones are refused rather than cut."""
    rows = _few_rows(df)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([number(x) for x in r]) for r in rows]]) + "\n"
