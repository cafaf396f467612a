"""Three-way merge of two branches of a table of texts, by native expressions inside each row.

Each branch changes a base row's columns, its lines and the gaps after them, drops the row, or adds a row. A text is split into
an array; every line becomes a struct of the line and both branches' codes, then a struct of the merged state (the lines it leaves, and what was
met); counters are aggregated over that array, the lines are flattened and joined. So a row never becomes more than one row, nothing is
shuffled but the added rows (id and columns, no texts), and a long text costs its own task only.

A branch is a function from a name's expression to its code (SQL text): ``row``, a column's name or a line's number. Codes: 0 drops (columns:
empties), 1 and 2 append ``!`` and ``?`` (lines and columns), 3 and 4 insert such a line after a line, or add a row with such a text.

Defined results: nulls in columns become empty first; a null or empty text is one empty line; rows without a doc_id are merged like others, under an
empty id, and what they add is one row without an id; rows that are repeated are merged each by itself, and the row that they add is there once
(where they disagree, the smallest by text, then columns); an added row whose id the table has already is a row beside it; an empty table gives
an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Branch = Callable[[str], str]
MARKS = "CASE {c} WHEN {a} THEN '!' WHEN {b} THEN '?' END"


def hashed(branch: str, modulus: int = 17) -> Branch:
    """Codes by crc32 of ``branch:id:name``; the row's id is in ``_id``."""
    return lambda name: f"cast(pmod(crc32(concat('{branch}:', _id, ':', {name})), {modulus}) as int)"


def _edited(code: str, column: str) -> str:
    return f"CASE {code} WHEN 0 THEN '' WHEN 1 THEN concat({column}, '!') WHEN 2 THEN concat({column}, '?') ELSE {column} END"


def _state(code: str, x: str) -> str:
    """A line under one branch's code: the lines it leaves."""
    return (
        f"CASE {code} WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array(concat({x}, '!')) WHEN 2 THEN array(concat({x}, '?')) "
        f"WHEN 3 THEN array({x}, '!') WHEN 4 THEN array({x}, '?') ELSE array({x}) END"
    )


#: What a line or a gap met: 0 nothing, 1 clean, 2 edit and edit, 3 edit and delete, 4 insert and insert.
_LINE = "CASE WHEN z.l > 2 AND z.r > 2 THEN 0 WHEN z.l > 2 OR z.r > 2 OR z.l = z.r THEN 1 WHEN z.l = 0 OR z.r = 0 THEN 3 ELSE 2 END"
_GAP = "CASE WHEN z.l NOT IN (3, 4) AND z.r NOT IN (3, 4) THEN 0 WHEN z.l NOT IN (3, 4) OR z.r NOT IN (3, 4) OR z.l = z.r THEN 1 ELSE 4 END"
# one branch has the line, the other the gap: both count, and the line's state comes first
_OUT = (
    f"CASE WHEN z.l <= 2 AND z.r IN (3, 4) THEN concat({_state('z.l', 'z.x')}, array({MARKS.format(c='z.r', a=3, b=4)})) "
    f"WHEN z.r <= 2 AND z.l IN (3, 4) THEN concat({_state('z.r', 'z.x')}, array({MARKS.format(c='z.l', a=3, b=4)})) "
    f"WHEN z.l <= 4 THEN {_state('z.l', 'z.x')} ELSE {_state('z.r', 'z.x')} END"
)


def _met(pair: tuple[str, str, str]) -> str:
    """What a column met, by value: base and both branches."""
    b, left, right = pair
    return f"CASE WHEN {left} = {b} AND {right} = {b} THEN 0 WHEN {left} = {b} OR {right} = {b} OR {left} = {right} THEN 1 ELSE 2 END"


def merge(docs: DataFrame, left: Branch, right: Branch, left_id: str = "-1 - doc_id", right_id: str = "-5 - doc_id", columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, ``columns``, text (null where the merge has no row), n_clean, n_edit_edit, n_edit_delete, n_insert_insert."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), *filled, F.coalesce("text", F.lit("")).alias("text"))
    kept = _kept(base, left, right, columns)
    return kept.unionByName(_added(base.drop("text"), left, right, left_id, right_id, columns))


def _kept(base: DataFrame, left: Branch, right: Branch, columns: tuple[str, ...]) -> DataFrame:
    """The rows of the base: merged, or without columns and text where they are dropped."""
    x = base.selectExpr("*", f"{left(chr(39) + 'row' + chr(39))} AS _row_l", f"{right(chr(39) + 'row' + chr(39))} AS _row_r")
    for c in columns:
        for side, code in (("l", left), ("r", right)):
            x = x.withColumn(f"_{c}_{side}", F.expr(_edited(code(f"'{c}'"), c)))
    struct = f"named_struct('x', x, 'l', {left('cast(i as string)')}, 'r', {right('cast(i as string)')})"
    x = x.withColumn("_lines", F.expr(f"transform(split(text, '\\n', -1), (x, i) -> {struct})"))
    x = x.withColumn("_merged", F.expr(f"transform(_lines, z -> named_struct('out', {_OUT}, 'line', {_LINE}, 'gap', {_GAP}))"))
    met = [_met((c, f"_{c}_l", f"_{c}_r")) for c in columns]
    for side in "lr":
        moved = " OR ".join([f"exists(_lines, z -> z.{side} <= 4)", *[f"_{c}_{side} <> {c}" for c in columns]])
        x = x.withColumn(f"_moved_{side}", F.expr(moved))
    x = x.withColumn("_column", F.expr(f"array({', '.join(met)})"))

    def count(kind: int) -> str:
        return f"(a.n{kind} + if(m.line = {kind}, 1, 0) + if(m.gap = {kind}, 1, 0)) AS n{kind}"

    none = "struct(" + ", ".join(f"cast(size(filter(_column, k -> k = {k})) as bigint) AS n{k}" for k in (1, 2, 3, 4)) + ")"
    x = x.withColumn("_count", F.expr(f"aggregate(_merged, {none}, (a, m) -> struct({', '.join(map(count, (1, 2, 3, 4)))}))"))
    drop, torn = "_row_l = 0 OR _row_r = 0", "(_row_l = 0 AND _row_r <> 0 AND _moved_r) OR (_row_r = 0 AND _row_l <> 0 AND _moved_l)"
    own = f"array_join(flatten(transform(_lines, z -> {_state('z.l', 'z.x')})), '\\n')"
    # dropped on the right alone: what the left has changed stays
    said = "CASE WHEN _row_l = 0 THEN NULL WHEN _row_r <> 0 THEN {both} WHEN _moved_l THEN {left} END"
    number = lambda k, dropped: f"CASE WHEN {drop} THEN {dropped} ELSE _count.n{k} END"
    return x.selectExpr(
        "doc_id",
        *[f"{said.format(both=f'if(_{c}_l <> {c}, _{c}_l, _{c}_r)', left=f'_{c}_l')} AS {c}" for c in columns],
        f"{said.format(both='array_join(flatten(transform(_merged, m -> m.out)), chr(10))', left=own)} AS text",
        f"{number(1, f'if({torn}, 0L, 1L)')} AS n_clean", f"{number(2, '0L')} AS n_edit_edit", f"{number(3, f'if({torn}, 1L, 0L)')} AS n_edit_delete", f"{number(4, '0L')} AS n_insert_insert",
    )


def _added(base: DataFrame, left: Branch, right: Branch, left_id: str, right_id: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows that a branch adds, one for each id; both branches' rows of an id meet in one aggregate."""
    both = []
    for side, code, its_id in (("l", left, left_id), ("r", right, right_id)):
        x = base.selectExpr("*", f"{code(chr(39) + 'row' + chr(39))} AS _code").filter("_code IN (3, 4)")
        row = f"struct({MARKS.format(c='_code', a=3, b=4)} AS text, {', '.join(columns)})"
        both.append(x.selectExpr(f"{its_id} AS doc_id", *[f"{row if s == side else 'NULL'} AS {s}" for s in "lr"]))
    x = both[0].unionByName(both[1]).groupBy("doc_id").agg(F.min("l").alias("l"), F.min("r").alias("r"))
    torn = "l IS NOT NULL AND r IS NOT NULL AND l <> r"
    x = x.selectExpr("doc_id", "coalesce(l, r) AS row", f"if({torn}, 1L, 0L) AS torn")
    return x.selectExpr("doc_id", *[f"row.{c}" for c in columns], "row.text", "1 - torn AS n_clean", "0L AS n_edit_edit", "0L AS n_edit_delete", "torn AS n_insert_insert")


def op13(docs: DataFrame) -> DataFrame:
    x = merge(docs, hashed("L"), hashed("R"))
    return x.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert",
    )


#: crc32 of a text, by its table of 256 values (made from the polynomial): SQL text for an expression, the table being in ``crc.tab``.
CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
)


def crc_sql(text: str) -> str:
    pair = f"('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda j: {pair})"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _sql() -> str:
    """Lines as rows, grouped again: another way than the operator's."""
    code = lambda side, name: f"{crc_sql(f'{chr(39)}{side}:{chr(39)} || id || {chr(39)}:{chr(39)} || {name}')} % 17"
    edit = lambda c, col: f"CASE {c} WHEN 0 THEN '' WHEN 1 THEN {col} || '!' WHEN 2 THEN {col} || '?' ELSE {col} END"
    mark = lambda c: f"CASE {c} WHEN 3 THEN '!' WHEN 4 THEN '?' END"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
r AS (SELECT *, {code('L', "'row'")} AS rl, {code('R', "'row'")} AS rr, {code('L', "'lang'")} AS cl, {code('R', "'lang'")} AS cr, {code('L', "'source'")} AS sl, {code('R', "'source'")} AS sr FROM d, crc),
c AS (SELECT *, {edit('cl', 'lang')} AS lang_l, {edit('cr', 'lang')} AS lang_r, {edit('sl', 'source')} AS source_l, {edit('sr', 'source')} AS source_r FROM r),
u AS (SELECT k, id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
v AS (SELECT k, i, x, {code('L', 'i::VARCHAR')} AS l, {code('R', 'i::VARCHAR')} AS r FROM u, crc),
w AS (SELECT *, l <= 2 AS el, r <= 2 AS er, {mark('l')} AS gl, {mark('r')} AS gr FROM v),
s AS (SELECT *, CASE WHEN el THEN l WHEN er THEN r ELSE 9 END AS e, coalesce(gl, gr) AS g FROM w),
p AS (SELECT k, i, 0 AS part, CASE e WHEN 1 THEN x || '!' WHEN 2 THEN x || '?' ELSE x END AS y FROM s WHERE e <> 0 UNION ALL SELECT k, i, 1, g FROM s WHERE g IS NOT NULL),
o AS (SELECT k, i, 0 AS part, CASE l WHEN 1 THEN x || '!' WHEN 2 THEN x || '?' ELSE x END AS y FROM w WHERE l <> 0 UNION ALL SELECT k, i, 1, gl FROM w WHERE gl IS NOT NULL),
t AS (SELECT k, string_agg(y, chr(10) ORDER BY i, part) AS joint FROM p GROUP BY k), tl AS (SELECT k, string_agg(y, chr(10) ORDER BY i, part) AS own FROM o GROUP BY k),
n AS (SELECT k, bool_or(l <= 4) AS moved_l, bool_or(r <= 4) AS moved_r,
  count(*) FILTER (el <> er OR (el AND er AND l = r)) + count(*) FILTER ((gl IS NULL) <> (gr IS NULL) OR gl = gr) AS clean,
  count(*) FILTER (el AND er AND l <> r AND l > 0 AND r > 0) AS ee, count(*) FILTER (el AND er AND l <> r AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (gl <> gr) AS ii
  FROM w GROUP BY k),
b AS (SELECT c.*, joint, own, clean, ee, ed, ii, moved_l OR lang_l <> lang OR source_l <> source AS ml, moved_r OR lang_r <> lang OR source_r <> source AS mr,
  (lang_l <> lang AND lang_r <> lang AND lang_l <> lang_r)::INT + (source_l <> source AND source_r <> source AND source_l <> source_r)::INT AS torn,
  (lang_l <> lang OR lang_r <> lang)::INT + (source_l <> source OR source_r <> source)::INT AS met
  FROM c JOIN n ON c.k = n.k LEFT JOIN t ON c.k = t.k LEFT JOIN tl ON c.k = tl.k),
q AS (SELECT *, rl = 0 OR rr = 0 AS dropped, (rl = 0 AND rr <> 0 AND mr) OR (rr = 0 AND rl <> 0 AND ml) AS fought FROM b),
a AS (SELECT -1 - doc_id AS doc_id, min(struct_pack(t := {mark('rl')}, lang := lang, source := source)) AS l, NULL AS r FROM c WHERE rl IN (3, 4) GROUP BY 1
  UNION ALL SELECT -5 - doc_id, NULL, min(struct_pack(t := {mark('rr')}, lang := lang, source := source)) FROM c WHERE rr IN (3, 4) GROUP BY 1),
z AS (SELECT doc_id, any_value(l) AS l, any_value(r) AS r FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN rl = 0 THEN NULL WHEN rr <> 0 THEN CASE WHEN lang_l <> lang THEN lang_l ELSE lang_r END WHEN ml THEN lang_l END AS lang,
  CASE WHEN rl = 0 THEN NULL WHEN rr <> 0 THEN CASE WHEN source_l <> source THEN source_l ELSE source_r END WHEN ml THEN source_l END AS source,
  sha256(CASE WHEN rl = 0 THEN NULL WHEN rr <> 0 THEN coalesce(joint, '') WHEN ml THEN coalesce(own, '') END) AS text_sha256,
  CASE WHEN NOT dropped THEN clean + met - torn WHEN fought THEN 0 ELSE 1 END::BIGINT AS n_clean, CASE WHEN dropped THEN 0 ELSE ee + torn END::BIGINT AS n_edit_edit,
  CASE WHEN NOT dropped THEN ed WHEN fought THEN 1 ELSE 0 END::BIGINT AS n_edit_delete, CASE WHEN dropped THEN 0 ELSE ii END::BIGINT AS n_insert_insert
FROM q
UNION ALL
SELECT doc_id, coalesce(l, r).lang, coalesce(l, r).source, sha256(coalesce(l, r).t), (l IS NULL OR r IS NULL OR l = r)::BIGINT, 0, 0, (l IS NOT NULL AND r IS NOT NULL AND l <> r)::BIGINT FROM z
"""


OP13_SQL = _sql()
