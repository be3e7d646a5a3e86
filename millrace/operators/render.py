"""Structured records as text: training documents, schema DDL, prompts, SQL extraction."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import collapse, strip

#: Section marks of rendered documents, and alias lists tried in order.
SCHEMA_MARK, QUESTION_MARK, THINK_MARK, SQL_MARK = "<|schema|>", "<|question|>", "<|think|>", "<|sql|>"
SCHEMA_ALIASES, SQL_ALIASES, COT_ALIASES = ("schema", "ddl", "create_statements"), ("sql", "SQL", "query"), ("cot", "chain_of_thought", "reasoning")


def filled(text: Column) -> Column:
    """The stripped text, null if blank."""
    return F.nullif(strip(text), F.lit(""))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*map(filled, texts), F.lit(None).cast("string"))


def alias(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-blank of the columns that df has among `names`, matched by exact case."""
    return first_filled(*[F.col(f"`{c}`") for c in names if c in df.columns])


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """rows with the columns of a lookup table; rows without a match stay. Spark broadcasts the table if it is small."""
    return rows.join(table, rows[key] == table[table_key], "left")


def as_documents(records: DataFrame, name: str, index: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """((id, seq, text, source), skipped records): a record whose text is blank is skipped but keeps its index."""
    made = records.withColumn("_text", text)
    good = F.col("_text").isNotNull() & (strip(F.col("_text")) != "")
    docs = made.where(good).select(F.concat_ws("-", F.lit(name), F.col(index).cast("string")).alias("id"), F.col(index).alias("seq"), F.col("_text").alias("text"), F.lit(name).alias("source"))
    return docs, made.where(~F.coalesce(good, F.lit(False))).drop("_text")


def nl_sql_document(ddls: Column | None, schema: Column, question: Column, cot: Column, sql: Column) -> Column:
    """Schema, question, reasoning if any, and SQL; null where a required part is missing.

    `ddls` is an array of statements, preferred to the inline `schema` text."""
    own = schema
    if ddls is not None:
        joined = F.array_join(F.filter(F.transform(ddls, strip), lambda d: d != ""), "\n\n")
        own = F.coalesce(F.nullif(joined, F.lit("")), schema)
    part = lambda mark, text: F.concat(F.lit(mark + "\n"), text)
    text = F.concat_ws("\n", part(SCHEMA_MARK, own), part(QUESTION_MARK, filled(question)), part(THINK_MARK, filled(cot)), part(SQL_MARK, filled(sql)))
    return F.when(own.isNotNull() & filled(question).isNotNull() & filled(sql).isNotNull(), text)


def schema_ddl(tables: Column) -> Column:
    """CREATE TABLE statements out of an array of tables.

    tables: array<struct<name, columns array<struct<name, type, nullable, unique, default>>, primary_keys array<string>,
    foreign_keys array<struct<columns array<string>, foreign_table, referred_columns array<string>>>>>; order is kept."""

    def column(c: Column) -> Column:
        kind = F.nullif(c["type"], F.lit(""))
        return F.concat(F.lit("  "), F.concat_ws(" ", F.nullif(c["name"], F.lit("")), kind, F.when(c["nullable"] == F.lit(False), F.lit("NOT NULL")), F.when(c["unique"] == F.lit(True), F.lit("UNIQUE")), F.concat(F.lit("DEFAULT "), c["default"])))

    def foreign(k: Column) -> Column:
        return F.concat(F.lit("  FOREIGN KEY ("), F.array_join(k["columns"], ", "), F.lit(") REFERENCES "), k["foreign_table"], F.lit(" ("), F.array_join(F.coalesce(k["referred_columns"], F.array().cast("array<string>")), ", "), F.lit(")"))

    none = F.array().cast("array<string>")

    def statement(t: Column) -> Column:
        keys = F.coalesce(t["primary_keys"], none)
        primary = F.when(F.size(keys) > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join(keys, ", "), F.lit(")")))).otherwise(none)
        usable = F.filter(t["foreign_keys"], lambda k: (F.size(F.coalesce(k["columns"], none)) > 0) & (F.coalesce(k["foreign_table"], F.lit("")) != ""))
        lines = F.concat(F.transform(t["columns"], column), primary, F.coalesce(F.transform(usable, foreign), none))
        return F.when(F.size(lines) > 0, F.concat(F.lit("CREATE TABLE "), t["name"], F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n)")))

    return F.array_join(F.filter(F.transform(F.filter(tables, lambda t: t["columns"].isNotNull()), statement), lambda s: s.isNotNull()), "\n\n")


def schema_document(tables: Column) -> Column:
    """A document of the schema alone; null if nothing can be rendered."""
    return F.concat(F.lit(SCHEMA_MARK + "\n"), F.nullif(schema_ddl(tables), F.lit("")))


@dataclass(frozen=True)
class PromptSpec:
    """A named prompt format; its id changes with any of its parts."""

    name: str
    template: str  # fields {ddl}, {evidence_block}, {question}
    evidence_line: str  # field {evidence}; left out where the evidence is blank
    repair_template: str  # fields {failed_sql}, {error}
    completion_prefix: str = ""

    @property
    def spec_id(self) -> str:
        parts = (self.name, self.template, self.evidence_line, self.repair_template, self.completion_prefix)
        return f"{self.name}@{hashlib.sha256(chr(31).join(parts).encode()).hexdigest()[:12]}"

    def render(self, ddl: Column, question: Column, evidence: Column) -> Column:
        block = F.when(strip(F.coalesce(evidence, F.lit(""))) != "", _fill(self.evidence_line, evidence=evidence)).otherwise(F.lit(""))
        return _fill(self.template, ddl=ddl, evidence_block=block, question=question)

    def repair(self, prompt: Column, failed_sql: Column, error: Column) -> Column:
        return F.concat(prompt, _fill(self.repair_template, failed_sql=failed_sql, error=error))


def _fill(template: str, **fields: Column) -> Column:
    """The template with its {fields} replaced, as one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        at, name = min(((rest.find("{" + f + "}"), f) for f in fields if "{" + f + "}" in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), fields[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


#: The two prompt formats.
_EVIDENCE = "-- External knowledge: {evidence}\n"
_BODY = "-- SQLite schema:\n{ddl}\n\n{evidence_block}-- Question: {question}\n-- SQL:\n"
_REPAIR = "{failed_sql}\n-- The query above failed: {error}\n-- Corrected SQL:\n"
DDL_PROMPT = PromptSpec("bird-ddl-v1", _BODY, _EVIDENCE, _REPAIR)
SELECT_PROMPT = PromptSpec("bird-ddl-v1-selectcue", _BODY + "SELECT", _EVIDENCE, _REPAIR + "SELECT", "SELECT")


def extract_sql(completion: Column) -> Column:
    """The statement in a completion: one fence unwrapped, leading comment lines dropped, cut at the first semicolon."""
    text = strip(completion)
    opened = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit(""))
    fenced = strip(F.when(F.locate("```", opened) > 0, F.substring_index(opened, "```", 1)).otherwise(opened))
    plain = F.when(text.startswith("```"), fenced).otherwise(text)
    bare = F.regexp_replace(plain, r"^(?:--[^\n]*(?:\n\s*|\z))+", "")
    return strip(F.substring_index(bare, ";", 1))


def one_line(sql: Column) -> Column:
    return collapse(sql)


def eval_text(question: Column, sql: Column) -> Column:
    """Question and SQL as one text; blank parts are left out, null if nothing is left."""
    return F.nullif(F.concat_ws(" ", filled(question), filled(sql)), F.lit(""))


def eval_texts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Each non-blank field as an entry of its own: (field, text)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    return rows.select(F.explode(pairs).alias("e")).select("e.field", "e.text").where(filled(F.col("text")).isNotNull())


def normalise_pair(df: DataFrame) -> DataFrame:
    """(db_id, question, evidence, sql) out of any of the record dialects."""
    evidence = first_filled(*[F.col(c) for c in ("external_knowledge", "evidence") if c in df.columns])
    return df.select("db_id", "question", F.coalesce(evidence, F.lit("")).alias("evidence"), alias(df, SQL_ALIASES).alias("sql"))
