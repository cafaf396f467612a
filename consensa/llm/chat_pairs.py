"""Preference formatting of chosen and rejected conversations.

The two conversations of a pair are compared turn by turn (role and text, nulls equal each other); their longest
common turn prefix is rendered once as the prompt, and what follows on either side is rendered as a completion.
A turn is ``<|role|>\\ntext<|end|>\\n``. A completion's mask lists the code-point ranges (start:end, end
exclusive, comma-joined) of its assistant texts with their end marks: only these are learned from.

Only DataFrame functions are used, and one shuffle by pair. A conversation becomes one text cell, so its
turns meet in one row; nothing else is gathered.

Defined results: conv_id 2p is chosen and 2p + 1 rejected in pair p; a pair with one side only has an empty
prompt, that side's whole text and null for the other; identical conversations give empty completions; null role
and text render as empty; repeated turns are kept, in the order of turn, role, text; null conv_ids take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat('<|', coalesce(x.role, ''), '|>\\n', coalesce(x.text, ''), '{END}\\n')), '')"


def _mask(turns: str) -> str:
    head = "length(coalesce(x.role, '')) + 5"
    body = f"length(coalesce(x.text, '')) + {len(END)}"
    span = f"concat_ws(':', cast(a.at + {head} as string), cast(a.at + {head} + {body} as string))"
    return f"""aggregate({turns}, struct(0 as at, cast(array() as array<string>) as spans),
        (a, x) -> struct(a.at + {head} + {body} + 1 as at, if(x.role = 'assistant', concat(a.spans, array({span})), a.spans) as spans),
        a -> array_join(a.spans, ','))"""


def format_pairs(turns: DataFrame) -> DataFrame:
    """From (pair_id, is_chosen, turn, role, text): one row a pair with prompt, completions and masks."""
    said = F.struct("turn", "role", "text")
    side = lambda x: F.sort_array(F.collect_list(F.when(x, said)))
    x = turns.groupBy("pair_id").agg(side(F.col("is_chosen")).alias("c"), side(~F.col("is_chosen")).alias("r"))
    same = "transform(slice(c, 1, least(size(c), size(r))), (x, i) -> x.role <=> r[i].role and x.text <=> r[i].text)"
    x = x.withColumn("same", F.expr(same))
    x = x.withColumn("prefix_turns", F.expr("cast(if(array_position(same, false) = 0, size(same), array_position(same, false) - 1) as int)"))
    x = x.withColumn("head", F.expr("slice(c, 1, prefix_turns)"))
    for k in "cr":
        x = x.withColumn(
            f"{k}_rest",
            F.expr(f"if(size({k}) = 0, null, if(size({k}) > prefix_turns, slice({k}, prefix_turns + 1, size({k})), slice({k}, 1, 0)))"),
        )
    return x.select(
        "pair_id", "prefix_turns", F.expr(_render("head")).alias("prompt"),
        F.expr(_render("c_rest")).alias("chosen"), F.expr(_mask("c_rest")).alias("chosen_mask"),
        F.expr(_render("r_rest")).alias("rejected"), F.expr(_mask("r_rest")).alias("rejected_mask"),
    )


def op9(conversations: DataFrame) -> DataFrame:
    rows = conversations.filter("conv_id is not null")
    return format_pairs(rows.select(
        F.expr("shiftright(cast(conv_id as long), 1)").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn",
        "role", "text",
    ))


OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
m AS (
  SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role0 IS DISTINCT FROM b.role0 OR a.text0 IS DISTINCT FROM b.text0 GROUP BY a.pair_id),
l AS (SELECT p.pair_id, nc, nr, coalesce(m.i - 1, least(nc, nr)) AS n FROM p LEFT JOIN m USING (pair_id)),
r AS (
  SELECT t.pair_id, t.side, t.i, l.n, t.role, '<|' || role || '|>' || chr(10) || text || '{END}' || chr(10) AS said,
         length(role) + 5 AS head, length(text) + {len(END)} AS body
  FROM t JOIN l USING (pair_id)),
o AS (
  SELECT *, sum(head + body + 1) OVER (PARTITION BY pair_id, side ORDER BY i) - (head + body + 1) AS pos FROM r WHERE i > n),
g AS (
  SELECT pair_id, side, string_agg(said, '' ORDER BY i) AS txt,
         coalesce(string_agg((pos + head)::BIGINT::VARCHAR || ':' || (pos + head + body)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (role = 'assistant'), '') AS mask
  FROM o GROUP BY pair_id, side),
h AS (SELECT pair_id, string_agg(said, '' ORDER BY i) AS prompt FROM r WHERE side = 0 AND i <= n GROUP BY pair_id)
SELECT l.pair_id, l.n::INTEGER AS prefix_turns, coalesce(h.prompt, '') AS prompt,
  CASE WHEN nc > 0 THEN coalesce(c.txt, '') END AS chosen, CASE WHEN nc > 0 THEN coalesce(c.mask, '') END AS chosen_mask,
  CASE WHEN nr > 0 THEN coalesce(j.txt, '') END AS rejected, CASE WHEN nr > 0 THEN coalesce(j.mask, '') END AS rejected_mask
FROM l LEFT JOIN h USING (pair_id) LEFT JOIN g c ON c.pair_id = l.pair_id AND c.side = 0 LEFT JOIN g j ON j.pair_id = l.pair_id AND j.side = 1
"""
