"""Fill-in-middle examples from documents, in DuckDB on Arrow batches.

A text is cut into units (lines), two cuts are drawn from a hash of its id, and
prefix, middle and suffix are put behind sentinels in one of two orders: psm
(prefix, suffix, middle) or spm (suffix, prefix, middle). What is not
transformed, or can't be, stays plain. All string work is SQL that DuckDB runs
on a registered batch; no row becomes a Python object.

``transform`` gives the output texts, ``restore`` rebuilds texts from outputs
and forms alone. No text with a sentinel in it is transformed, so an output's
sentinels are its own: one ends in ``>`` and begins with ``<``, so none can
begin in a text's end or end in a text's beginning either.

Edge cases: a null text is an empty one, and plain. A null id is the empty text
in the hash; ids of other types count by their text. Equal rows give equal
rows. A text of one line has n = 1, so each cut is before or after it. An empty
table gives an empty result. A text may be as long as a batch may; DuckDB keeps
to ``MEMORY`` and writes no file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

MEMORY = "1GB"


@dataclass(frozen=True)
class Fim:
    """Pattern of a unit, seed, and out of 100 texts how many are transformed and how many of those are spm; the three sentinels."""

    unit: str = r"[^\n]*\n|[^\n]+"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or "<" in m[1:] or ">" in m[:-1] for m in marks):
            raise ValueError("sentinels must differ, begin with < and end with >, with neither inside")


def _text(value: str) -> str:
    """An SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def transform_sql(source: str, fim: Fim = Fim()) -> str:  # noqa: B008
    """DuckDB SQL over ``source`` (row, id, text): row, n, form, prefix_chars, middle_chars and output."""
    marks = [_text(m) for m in (fim.prefix, fim.suffix, fim.middle)]
    p, s, m = marks
    plain = " or ".join(["text = ''", *[f"contains(text, {x})" for x in marks], f"h3 % 100 >= {fim.rate}"])
    return f"""
with hashed as (
  select row, text, regexp_extract_all(text, {_text(fim.unit)}) as units, sha256('{fim.seed}:' || id) as h from {source}),
drawn as (
  select row, text, units, len(units) as n,
    ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
  from hashed),
formed as (
  select row, text, units, n, least(h1 % (n + 1), h2 % (n + 1))::bigint as one, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as two,
    case when {plain} then 'plain' when h4 % 100 < {fim.spm} then 'spm' else 'psm' end as form
  from drawn),
cut as (
  select row, text, n, form,
    array_to_string(list_slice(units, 1, one), '') as before, array_to_string(list_slice(units, one + 1, two), '') as middle, array_to_string(list_slice(units, two + 1, n), '') as after
  from formed)
select row, n::bigint as n, form,
  case when form <> 'plain' then length(before) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  case form when 'plain' then text when 'psm' then {p} || before || {s} || after || {m} || middle else {s} || after || {p} || before || {m} || middle end as output
from cut"""


def restore_sql(source: str, fim: Fim = Fim()) -> str:  # noqa: B008
    """DuckDB SQL over ``source`` (row, form, output): row and text."""
    p, s, m = fim.prefix, fim.suffix, fim.middle

    def between(start: str, end: str) -> str:
        """What stands between two sentinels, of which the first is the output's first."""
        return f"substr(output, {len(start) + 1}, strpos(output, {_text(end)}) - {len(start) + 1})"

    def behind(start: str, end: str) -> str:
        """What stands between the second sentinel and the third."""
        at = f"strpos(output, {_text(start)}) + {len(start)}"
        return f"substr(output, {at}, strpos(output, {_text(end)}) - ({at}))"

    last = f"substr(output, strpos(output, {_text(m)}) + {len(m)})"
    psm = f"{between(p, s)} || {last} || {behind(s, m)}"
    spm = f"{behind(p, m)} || {last} || {between(s, p)}"
    return f"select row, case form when 'plain' then output when 'psm' then {psm} else {spm} end as text from {source}"


def _session():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.execute("set preserve_insertion_order = true")
    return con


def _numbered(batch: pa.RecordBatch, names: dict[str, str]) -> pa.Table:
    """Columns of a batch under new names, with the rows' numbers."""
    return pa.table({"row": pa.array(range(batch.num_rows), pa.int64())} | {new: batch.column(batch.schema.get_field_index(old)) for old, new in names.items()})


def transform(docs: DataFrame, fim: Fim = Fim(), text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    sql = transform_sql("batch", fim) + " order by row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for batch in batches:
            con.register("batch", _numbered(batch, {"hashed_id": "id", "text": "text"}))
            out = con.sql(sql).to_arrow_table().drop_columns("row").add_column(0, "doc_id", batch.column(0))
            con.unregister("batch")
            yield from out.to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", id_text().alias("hashed_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, fim: Fim = Fim()) -> DataFrame:  # noqa: B008
    """All columns of ``outputs`` but ``output``, and the texts rebuilt from output and form."""
    sql = restore_sql("batch", fim) + " order by row"
    kept = [c for c in outputs.columns if c not in ("output", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for batch in batches:
            con.register("batch", _numbered(batch, {"form": "form", "output": "output"}))
            texts = con.sql(sql).to_arrow_table().column("text").combine_chunks()
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], texts], [*kept, "text"])

    schema = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in kept)
    return outputs.select(*kept, "output").mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:  # noqa: B008
    """doc_id, n, form, prefix_chars, middle_chars, and sha256 of the output and of the text rebuilt from it.

    Both steps run on one batch, one after the other, so outputs don't travel.
    """
    first, second = transform_sql("batch", fim), restore_sql("made", fim)
    sql = f"""
with made as ({first}), rebuilt as ({second})
select n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(rebuilt.text) as restored_sha256 from made join rebuilt using (row) order by row"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for batch in batches:
            con.register("batch", _numbered(batch, {"hashed_id": "id", "text": "text"}))
            out = con.sql(sql).to_arrow_table().add_column(0, "doc_id", batch.column(0))
            con.unregister("batch")
            yield from out.to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", id_text().alias("hashed_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: The same rows in DuckDB, over the whole table.
SQL = f"""
with batch as (select row_number() over () as row, doc_id, coalesce(doc_id::varchar, '') as id, coalesce(text, '') as text from documents),
made as ({transform_sql('batch')})
select doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(batch.text) as restored_sha256 from made join batch using (row)
"""
