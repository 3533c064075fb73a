"""Fill-in-middle by counted quantifiers: all column functions, no Python on executors.

A text's units are white space with the word behind it, or white space at its end. regexp_count gives their number; two
numbers drawn from the document's id say after how many units prefix and middle end. A pattern made for the row,
with possessive groups unit{a} and unit{b-a}, captures prefix, middle and suffix in one match, and the replacement
puts them in the row's order. Possessive groups give nothing back, so a long text needs no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import pick, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
#: for each form, the order of the parts behind their marks: groups 1 prefix, 2 middle, 3 suffix
ORDERS = {"psm": ((PREFIX, 1), (SUFFIX, 3), (MIDDLE, 2)), "spm": ((SUFFIX, 3), (PREFIX, 1), (MIDDLE, 2))}


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the hash of seed and id; a null id is drawn as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _template(form: str) -> str:
    return "".join(f"{mark}${group}" for mark, group in ORDERS[form])


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form: marks don't occur in the parts, so the first of each is the right one."""
    text = output
    for name, order in ORDERS.items():
        parts = r"\A" + "".join(f"{mark}(.{'*?' if i < 2 else '*'})" for i, (mark, _) in enumerate(order)) + r"\z"
        back = "".join(f"${1 + [g for _, g in order].index(group)}" for group in (1, 2, 3))
        text = F.when(form == name, F.regexp_replace(output, "(?s)" + parts, back)).otherwise(text)
    return text


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    Null texts are empty; empty texts and those that hold a mark stay plain. A null id draws as an empty one; repeated
    rows each get the same row; an empty table gives none.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    d = d.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(m)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    d = d.withColumn("form", form).withColumn("_a", h1 % (F.col("n") + 1)).withColumn("_b", h2 % (F.col("n") + 1))
    d = d.withColumn("_from", F.least("_a", "_b")).withColumn("_many", F.abs(F.col("_a") - F.col("_b")))
    counted = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), F.col("_from"), F.lit(rf"}}+)({UNIT}{{"), F.col("_many"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "spm", _template("spm")).otherwise(_template("psm"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", counted, order))
    d = d.withColumn("output", output)
    at = {m: F.instr("output", m) for m in (PREFIX, SUFFIX, MIDDLE)}
    behind = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    prefix = F.when(F.col("form") != "plain", behind - at[PREFIX] - len(PREFIX)).cast("long")
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] - len(MIDDLE) + 1).cast("long")
    return d.select("doc_id", "n", "form", prefix.alias("prefix_chars"), middle.alias("middle_chars"), "output")


def op12_counted_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents
), c as (
  select doc_id, text, u, len(u) as n,
    ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
      when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from d
), p as (
  select *, array_to_string(u[1:least(a, b)], '') as prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as middle, array_to_string(u[greatest(a, b) + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
