"""Tables for people: HTML cells, the page, quality summaries and histograms."""

from __future__ import annotations

import html as _html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, trim_blanks


def escape(x: Column | str) -> Column:
    """HTML-escaped text, quotes too; null is empty."""
    out = F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    return out


def _shown(x: Column | str) -> tuple[Column, Column]:
    """(trimmed text, whether there is nothing to show: null, blank or 'nan')."""
    t = trim_blanks((F.col(x) if isinstance(x, str) else x).cast("string"))
    return t, t.isNull() | (t == "") | (F.lower(t) == "nan")


def badge(x: Column | str, short: str) -> Column:
    """A compact badge that says ``short`` and shows the whole text as its tooltip; nothing for null, blank and 'nan'."""
    t, none = _shown(x)
    return F.when(none, "").otherwise(F.concat(F.lit('<span class="pill" title="'), escape(t), F.lit(f'">{_html.escape(short)}</span>')))


# What the two roles mean, and the badges of the annotation columns.
ROLES = {
    "Act": "Activating mutation (oncogene-like): mutation confers gain-of-function or increased activity.",
    "LoF": "Loss of Function (tumor suppressor-like): mutation likely inactivates or reduces the gene's function.",
}
BADGES = {"go_mf": "MF", "go_bp": "BP", "go_cc": "CC", "cancer_hallmark": "CH", "hallmark": "CH", "intogen_cohort": "Coh", "intogen_cancertype": "CT"}
# What the badges' short names stand for.
BADGE_NAMES = {"MF": "Molecular Function", "BP": "Biological Process", "CC": "Cellular Component", "CH": "Cancer Hallmark", "Coh": "IntOGen Cohort", "CT": "IntOGen Cancer Type"}


def driver_tip(x: Column | str) -> Column:
    """The driver roles with a tooltip: a line for each different role, those that begin with act and lof explained."""
    t, none = _shown(x)
    named = lambda k: F.coalesce(*[F.when(F.lower(k).startswith(r.lower()), F.lit(r)) for r in ROLES], k)
    roles = F.array_distinct(F.transform(F.filter(F.split(t, r"[;,\s]+"), lambda k: k != ""), named))
    lines = F.transform(roles, lambda k: F.coalesce(*[F.when(k == r, F.lit(f"{r}: {said}")) for r, said in ROLES.items()], k))
    return F.when(none, "").otherwise(F.concat(
        F.lit('<span class="driver" title="'), escape(F.array_join(lines, " \n")), F.lit('">'), escape(t), F.lit("</span>"),
    ))


def _key(column: str) -> str:
    return column.lower().replace(".", "_").replace("-", "_").replace(" ", "_")


def shapes(columns: list[str]) -> dict:
    """How a final table's columns are shown: driver roles with tooltips, terms as badges, sources by their display names."""
    out = {}
    for c in columns:
        key = _key(c)
        if key == "intogen_driver_role":
            out[c] = driver_tip
        elif key in BADGES:
            out[c] = lambda x, short=BADGES[key]: badge(x, short)
        elif key == "mutation_source":
            out[c] = lambda x: escape(display_source(x))
    return out


def display_source(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x == "Somatic", "Genomic").otherwise(x)


#: Style and behaviour of a page: search over all cells, sorting by a click on a column (numbers as numbers, a second click turns it), paging.
_STYLE = (
    "body{font-family:sans-serif;margin:16px}h1{font-size:20px}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px;vertical-align:top}th{cursor:pointer;white-space:nowrap}"
    ".pill{border-radius:9px;padding:1px 5px;background:#e8eef6;cursor:help}.driver{border-bottom:1px dotted #777;cursor:help}.bar>*{margin-right:8px}"
)
_SCRIPT = r"""
const body=document.getElementById('rows'),size=document.getElementById('size'),find=document.getElementById('find'),info=document.getElementById('info');
const given=[...body.rows];let order=given.slice(),at=0,column=-1,down=false;
const text=(row,i)=>row.cells[i].textContent.trim();
function matching(){const words=find.value.toLowerCase().split(/\s+/).filter(w=>w);return order.filter(row=>{const t=row.textContent.toLowerCase();return words.every(w=>t.includes(w))})}
function show(){const some=matching(),n=+size.value<0?Math.max(some.length,1):+size.value;at=Math.max(0,Math.min(at,Math.ceil(some.length/n)-1));
body.replaceChildren(...some.slice(at*n,(at+1)*n));info.textContent=some.length?`${at*n+1} to ${Math.min((at+1)*n,some.length)} of ${some.length}`:'none'}
function compare(a,b){const x=text(a,column),y=text(b,column),p=x===''?NaN:+x,q=y===''?NaN:+y;
if(x===''||y==='')return(x==='')-(y==='');const c=isNaN(p)||isNaN(q)?x.localeCompare(y):p-q;return down?-c:c}
document.querySelectorAll('th').forEach((th,i)=>th.onclick=()=>{down=column===i&&!down;column=i;order=given.slice().sort(compare);at=0;show()});
size.onchange=find.oninput=()=>{at=0;show()};document.getElementById('back').onclick=()=>{at--;show()};document.getElementById('next').onclick=()=>{at++;show()};show();
"""
PAGE_FOOT = f"</tbody></table><script>{_SCRIPT}</script></body></html>"


def page_head(title: Column, columns: list[str]) -> Column:
    """A page up to its rows: title, search, page sizes (25 first; 10, 25, 50, 100, all), and the names of the columns."""
    sizes = "".join(f"<option value='{v}'{' selected' * (v == 25)}>{s}</option>" for v, s in ((10, 10), (25, 25), (50, 50), (100, 100), (-1, "All")))
    bar = f"<div class='bar'><label>Rows <select id='size'>{sizes}</select></label><label>Search <input id='find' type='search'></label><button id='back'>Back</button><button id='next'>Next</button><span id='info'></span></div>"
    pills = "".join(f"<span class='pill'>{short}</span> {BADGE_NAMES[short]} " for short in dict.fromkeys(BADGES.values()) if any(BADGES.get(_key(c)) == short for c in columns))
    names = "".join(f"<th>{_html.escape(c)}</th>" for c in columns)
    t = escape(title)
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), t, F.lit(f"</title><style>{_STYLE}</style></head><body><h1>"), t,
        F.lit(f"</h1><p>{pills}</p>{bar}<table><thead><tr>{names}</tr></thead><tbody id='rows'>"),
    )


def summary(values: DataFrame, column: str, keys: list[str]) -> DataFrame:
    c = F.col(column)
    return values.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("sd"), F.max(c).alias("max"),
        F.min(c).alias("min"),
    )


def histogram(values: DataFrame, column: str, keys: list[str], bins: int | None = 200, least: int = 80, most: int = 300) -> DataFrame:
    """(keys, bin from 0, low, n): equal-width bins of the finite values.

    Without ``bins``, as many as the Freedman-Diaconis width asks, within bounds; where there is no such width, the number of values that differ in
    six places; ``least`` for a single value.
    """
    c = finite(F.col(column).cast("double"))
    s = values.groupBy(*keys).agg(
        F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("_n"), F.percentile(c, 0.25).alias("q1"),
        F.percentile(c, 0.75).alias("q3"), F.count_distinct(F.round(c, 6)).alias("u"),
    )
    if bins is None:
        width = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("_n").cast("double"), F.lit(1 / 3))
        wanted = F.when((width > 0) & (F.col("hi") > F.col("lo")), F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width))).otherwise(F.col("u"))
        s = s.withColumn("k", F.when(F.col("_n") < 2, least).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), wanted))).cast("int"))
    else:
        s = s.withColumn("k", F.lit(bins))
    x = values.filter(c.isNotNull()).join(s, keys)
    at = F.when(
        F.col("hi") > F.col("lo"), F.least(F.col("k") - 1, F.floor((c - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k"))),
    ).otherwise(0).cast("int")
    low = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.col("k")
    return x.withColumn("bin", at).groupBy(*keys, "bin", "lo", "hi", "k").agg(F.count("*").alias("n")).select(*keys, "bin", low.alias("low"), "n")
