"""Corpus and compression statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import word_count
from millrace.sources.paths import Replaced


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def corpus_stats(docs: DataFrame, targets: list[tuple[str, int]]) -> DataFrame:
    """One row a configured source in its order: present, docs, chars, approximate tokens, share and target ratio.

    Sources without documents have zeros; documents of other sources don't count."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(targets)], "ord int, name string, target_tokens long")
    counted = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    rows = F.broadcast(wanted).join(counted, F.col("name") == F.col("source"), "left").select("ord", F.col("name").alias("source"), "target_tokens", F.coalesce("n", F.lit(0)).alias("docs"), F.coalesce("size", F.lit(0)).cast("long").alias("chars"))
    rows = rows.withColumn("approx_tokens", F.floor(F.col("chars") / 4).cast("long"))
    total = rows.agg(F.sum("approx_tokens").alias("_all"))
    return rows.crossJoin(F.broadcast(total)).select(  # one row on the right
        "ord", "source", (F.col("docs") > 0).alias("present"), "docs", "chars", "approx_tokens", "target_tokens",
        F.bround(ratio(100 * F.col("approx_tokens"), F.col("_all")), 4).alias("share_pct"), F.bround(ratio(F.col("approx_tokens"), F.col("target_tokens")), 4).alias("actual_vs_target"),
    )


COLUMNS = ("source", "present", "docs", "chars", "approx_tok", "target_tok", "share%", "act/tgt")


def stats_table(stats: DataFrame) -> str:
    """The few rows of corpus_stats as aligned text with a TOTAL row."""
    found = stats.orderBy("ord").collect()
    total = {c: sum(r[c] for r in found) for c in ("docs", "chars", "approx_tokens", "target_tokens")}
    lines = [COLUMNS]
    lines += [(r["source"], "yes" if r["present"] else "no", *(str(r[c]) for c in total), f"{r['share_pct']:.2f}", f"{r['actual_vs_target']:.2f}") for r in found]
    share = "100.00" if total["approx_tokens"] else "0.00"
    lines.append(("TOTAL", "", *map(str, total.values()), share, f"{total['approx_tokens'] / total['target_tokens'] if total['target_tokens'] else 0.0:.2f}"))
    width = [max(len(line[k]) for line in lines) for k in range(len(COLUMNS))]
    return "\n".join("  ".join(c.rjust(w) if k else c.ljust(w) for k, (c, w) in enumerate(zip(line, width))).rstrip() for line in lines)


def fertility(texts: DataFrame, group: str, counts: list[str], overall: str | None = "overall") -> DataFrame:
    """Per group, and over all groups, documents, UTF-8 bytes, words, token sums and their ratios.

    The overall row adds up totals; ratios are never averaged. `counts` are columns with a text's token counts; the
    ratios are those of the first one."""
    sums = [F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(word_count(F.col("text"))).cast("long").alias("words"), *[F.sum(c).cast("long").alias(c) for c in counts]]
    out = texts.groupBy(F.col(group).alias("grp")).agg(*sums)
    if overall is not None:
        # the groups' totals are rolled up, not the texts, which would be doubled and counted twice
        rolled = out.rollup("grp").agg(F.grouping("grp").alias("_all"), *[F.sum(c).alias(c) for c in out.columns[1:]])
        out = rolled.withColumn("grp", F.when(F.col("_all") == 1, F.lit(overall)).otherwise(F.col("grp"))).drop("_all")
    if not counts:
        return out
    return out.withColumn("tokens_per_word", ratio(F.col(counts[0]), F.col("words"))).withColumn("bytes_per_token", ratio(F.col("n_bytes"), F.col(counts[0])))


def margins(measured: DataFrame, matched: str, other: str) -> DataFrame:
    """measured with the matched tokenizer's margin over another one in percent; groups without tokens are left out."""
    kept = measured.where(F.col(other) > 0)
    return kept.withColumn("margin_pct", (F.col(matched) - F.col(other)) / F.col(other) * 100.0).withColumn("wins", F.col(matched) < F.col(other))


def _put(path: str, text: str) -> None:
    with Replaced(path) as out:
        out.write(text.encode())


def write_rows(rows: DataFrame, path: str, order: str, **facts) -> dict:
    """Any small report (a panel, a gold certificate, scored examples) as JSON with sorted keys on the driver's machine."""
    import json

    report = facts | {"rows": [r.asDict(recursive=True) for r in rows.orderBy(order).collect()]}
    _put(path, json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")
    return report


def write_fertility(measured: DataFrame, path: str, counts: list[str]) -> str:
    """Fertility by group as a Markdown table, tokens per word of each tokenizer; the overall row first."""
    found = sorted(measured.collect(), key=lambda r: (r["grp"] != "overall", r["grp"] or ""))
    per_word = lambda r, c: f"{r[c] / r['words']:.3f}" if r["words"] else "-"
    lines = ["| group | docs | words | " + " | ".join(counts) + " |", "|---|" + "---:|" * (2 + len(counts))]
    lines += ["| " + " | ".join([r["grp"] or "", f"{r['docs']:,}", f"{r['words']:,}", *(per_word(r, c) for c in counts)]) + " |" for r in found]
    text = "\n".join(lines) + "\n"
    _put(path, text)
    return text


def write_report(stats: DataFrame, path: str, generated_at: str) -> dict:
    """A small report as JSON with sorted keys; returned as well."""
    import json

    report = {"generated_at": generated_at, "sources": [r.asDict() for r in stats.orderBy("ord").collect()]}
    _put(path, json.dumps(report, indent=2, sort_keys=True) + "\n")
    return report
