"""Report tables: small results as text.  Every function here takes a report whose size the caller has limited."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 1000
_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(text: object) -> str:
    return "".join(_ESCAPES.get(c, c) for c in str(text))


def feature_label(feature: str) -> str:
    """``pymfe__iq_range.mean`` as ``iq range (mean)``."""
    name, _, tail = feature.removeprefix("pymfe__").partition(".")
    return name.replace("_", " ") + (f" ({tail.replace('_', ' ')})" if tail else "")


def decimal(x: float | None, digits: int = 3) -> str:
    return "--" if x is None else f"{x:.{digits}f}"


def p_text(p: float | None) -> str:
    return "--" if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def interval(low: float | None, high: float | None, digits: int = 2) -> str:
    return "--" if low is None or high is None else f"[{low:.{digits}f}, {high:.{digits}f}]"


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def slug(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text.lower()).strip("_")


def booktabs(rows: Sequence[Sequence[object]], header: Sequence[str], caption: str, label: str) -> str:
    body = [" & ".join(map(latex, r)) + r" \\" for r in rows]
    head = " & ".join(rf"\textbf{{{latex(h)}}}" for h in header) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{latex(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * (len(header) - 1)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def _report_rows(report: DataFrame) -> list:
    """The rows of a report; one too long to print is an error, not a cut."""
    rows = report.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a printed table holds at most {MAX_ROWS} rows")
    return rows


def robust_table(robust: DataFrame, name: str) -> str:
    rows = _report_rows(robust.orderBy(F.desc("abs_spearman_rho"), "feature"))
    body = [(feature_label(r["feature"]), r["n"], decimal(r["spearman_rho"]), p_text(r["bh_q_value"]), interval(r["bootstrap_ci_low"], r["bootstrap_ci_high"]), decimal(r["bootstrap_sign_consistency"], 2)) for r in rows]
    return booktabs(body, ["feature", "n", "rho", "q", "interval", "sign"], f"Robust associations: {name}", f"tab:robust_{slug(name)}")


def nominal_table(tested: DataFrame, name: str, alpha: float = 0.05) -> str:
    rows = _report_rows(tested.where(F.col("p_value") < alpha).orderBy("p_value", "feature"))
    body = [(feature_label(r["feature"]), r["n"], decimal(r["spearman_r"]), p_text(r["p_value"]), p_text(r["p_value_bh"])) for r in rows]
    return booktabs(body, ["feature", "n", "rho", "p", "q"], f"Nominal associations: {name}", f"tab:nominal_{slug(name)}")
