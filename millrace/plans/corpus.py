"""Queries over the document stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import clean, dedup, render, sampling, shingles, stats
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import files

#: DuckDB fragments shared by the oracles: normalised text and the verdict over it.
WHITE_SQL = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NORM_SQL = (
    r"regexp_replace(regexp_replace(nfc_normalize(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '')), "
    rf"'\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g')"
)
VERDICT_SQL = r"""CASE WHEN length(t) < 200 THEN 'short' WHEN length(t) > 1000000 THEN 'long'
 WHEN (length(t) - length(regexp_replace(t, '[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\p{Cf}]', '', 'g'))) / length(t) > 0.05 THEN 'nonprintable' ELSE 'kept' END"""
CLEANED_SQL = f"normed AS (SELECT *, {NORM_SQL} AS t FROM documents), judged AS (SELECT *, {VERDICT_SQL} AS verdict FROM normed), cleaned AS (SELECT * FROM judged WHERE verdict = 'kept')"


@query("clean_verdicts_by_source", f"WITH {CLEANED_SQL} SELECT source, verdict, count(*) AS docs, CAST(sum(length(t)) AS BIGINT) AS chars FROM judged GROUP BY ALL")
def clean_verdicts_by_source(spark, sf_dir):
    judged = clean.with_verdict(table(spark, sf_dir, "documents").select("source", "text"))
    return judged.groupBy("source", "verdict").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "source", "lang")


def _cleaned(spark, sf_dir):
    return clean.clean(_docs(spark, sf_dir))


COLLAPSED = rf"regexp_replace(regexp_replace(text, '[{WHITE_SQL}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("clean_documents", f"WITH {CLEANED_SQL} SELECT doc_id AS seq, length(t) AS chars, md5(t) AS text_md5 FROM cleaned")
def clean_documents(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("seq", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query("clean_counters", f"WITH {CLEANED_SQL} SELECT count(*) AS docs_in, CAST(count_if(verdict = 'kept') AS BIGINT) AS docs_out, CAST(count_if(verdict = 'short') AS BIGINT) AS dropped_short, CAST(count_if(verdict = 'long') AS BIGINT) AS dropped_long, CAST(count_if(verdict = 'nonprintable') AS BIGINT) AS dropped_nonprintable FROM judged")
def clean_counters(spark, sf_dir):
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    return clean.with_verdict(_docs(spark, sf_dir)).agg(F.count("*").alias("docs_in"), verdict("kept").alias("docs_out"), verdict("short").alias("dropped_short"), verdict("long").alias("dropped_long"), verdict("nonprintable").alias("dropped_nonprintable"))


@query("nonprintable_ratio", r"SELECT doc_id AS seq, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE (length(text) - length(regexp_replace(text, '[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}\p{Cf}]', '', 'g'))) / length(text) END, 9) AS ratio FROM documents")
def nonprintable_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("seq", F.round(T.nonprintable_ratio(F.col("text")), 9).alias("ratio"))


@query("exact_dedup", f"SELECT doc_id AS seq, CASE WHEN row_number() OVER (PARTITION BY {COLLAPSED} ORDER BY doc_id) = 1 THEN 'unique' ELSE 'dropped' END AS verdict FROM documents")
def exact_dedup(spark, sf_dir):
    return dedup.with_exact_verdict(_docs(spark, sf_dir)).select("seq", "verdict")


@query("exact_dedup_bytes", "SELECT doc_id AS seq, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'unique' ELSE 'dropped' END AS verdict FROM documents")
def exact_dedup_bytes(spark, sf_dir):
    return dedup.with_exact_verdict(_docs(spark, sf_dir), whitespace=True).select("seq", "verdict")


@query("union_scan", "SELECT origin, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin")
def union_scan(spark, sf_dir):
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("origin"), "text") for name in ("documents", "benchmark", "conversations")]
    return files.concat(*parts).groupBy("origin").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


def _grams_sql(table_name: str, key: str, n: int, text: str = "text") -> str:
    words = f"(SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table_name})"
    return f"(SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {words} WHERE len(w) >= {n}))"


@query("shingles_5", f"SELECT doc_id AS seq, count(*) AS shingles FROM {_grams_sql('documents', 'doc_id', 5)} GROUP BY doc_id")
def shingles_5(spark, sf_dir):
    grams = _docs(spark, sf_dir).select("seq", F.size(shingles.gram_hashes(F.col("text"), 5)).cast("long").alias("shingles"))
    return grams.where("shingles > 0")


@query("ngram_index", f"SELECT count(DISTINCT gram) AS grams FROM {_grams_sql('benchmark', 'item_id', 13)}")
def ngram_index(spark, sf_dir):
    return shingles.build_index(table(spark, sf_dir, "benchmark")).agg(F.count("*").alias("grams"))


OVERLAP_SQL = f"(SELECT doc_id, count(*) AS overlap FROM {_grams_sql('documents', 'doc_id', 13)} WHERE gram IN (SELECT gram FROM {_grams_sql('benchmark', 'item_id', 13)}) GROUP BY doc_id)"


@query("ngram_overlap", f"SELECT doc_id AS seq, overlap FROM {OVERLAP_SQL}")
def ngram_overlap(spark, sf_dir):
    return shingles.overlaps(_docs(spark, sf_dir), shingles.build_index(table(spark, sf_dir, "benchmark")))


@query("decontaminate", f"SELECT doc_id AS seq FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {OVERLAP_SQL})")
def decontaminate(spark, sf_dir):
    return shingles.decontaminate(_docs(spark, sf_dir), shingles.build_index(table(spark, sf_dir, "benchmark"))).select("seq")


@query("decontaminate_threshold", f"SELECT doc_id AS seq FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {OVERLAP_SQL} WHERE overlap >= 20)")
def decontaminate_threshold(spark, sf_dir):
    return shingles.decontaminate(_docs(spark, sf_dir), shingles.build_index(table(spark, sf_dir, "benchmark")), threshold=20).select("seq")


@query("near_dedup")
def near_dedup(spark, sf_dir):
    return dedup.with_near_verdict(_docs(spark, sf_dir)).select("seq", "verdict")


@query("corpus_pipeline_counts")
def corpus_pipeline_counts(spark, sf_dir):
    """Documents left after each stage: clean, exact, near, decontaminated."""
    cleaned = _cleaned(spark, sf_dir)
    unique = dedup.exact(cleaned)
    distinct = dedup.near(unique)
    pure = shingles.decontaminate(distinct, shingles.build_index(table(spark, sf_dir, "benchmark")))
    steps = [("clean", cleaned), ("exact", unique), ("near", distinct), ("decontaminated", pure)]
    return files.concat(*[d.agg(F.count("*").alias("docs")).select(F.lit(name).alias("stage"), "docs") for name, d in steps])


def _md5_low(gram):
    return F.conv(F.substring(F.md5(gram), 25, 8), 16, 10).cast("long")


_A, _B = dedup.permutations(128)
_PERMS_SQL = "perms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::UBIGINT, {b}::UBIGINT)" for i, (a, b) in enumerate(zip(_A.tolist(), _B.tolist()))) + ") AS p(i, a, b))"
MD5_LINKS_SQL = f"""
WITH {_PERMS_SQL},
firsts AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY {COLLAPSED}),
hashed AS (SELECT doc_id, ('0x' || md5(gram)[25:32])::UBIGINT AS x FROM {_grams_sql('firsts', 'doc_id', 5)}),
sig AS (SELECT doc_id, i, min((a * x + b) % 4294967311) AS v FROM hashed, perms GROUP BY doc_id, i),
full_sig AS (SELECT doc_id, list(v ORDER BY i) AS s FROM sig GROUP BY doc_id),
own AS (SELECT min(doc_id) AS doc_id, s FROM full_sig GROUP BY s),
bands AS (SELECT doc_id, k, s[k * 8 + 1:k * 8 + 8] AS band FROM own, (SELECT unnest(range(0, 16)) AS k)),
cand AS (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM bands l JOIN bands r ON l.k = r.k AND l.band = r.band AND l.doc_id < r.doc_id)
SELECT a, b FROM (SELECT a, b, list_sum(list_transform(range(1, 129), lambda k: CASE WHEN x.s[k] = y.s[k] THEN 1 ELSE 0 END)) AS same FROM cand JOIN own x ON x.doc_id = a JOIN own y ON y.doc_id = b) WHERE same / 128 >= 0.8
"""


@query("near_dedup_links_md5", MD5_LINKS_SQL)
def near_dedup_links_md5(spark, sf_dir):
    """The MinHash chain over a base hash that SQL has too: the low 32 bits of md5."""
    docs = dedup.exact(_docs(spark, sf_dir))
    grams = docs.select("seq", F.transform(shingles.grams(F.col("text"), 5), _md5_low).alias("grams"))
    first = dedup.signatures(grams).groupBy("sig").agg(F.min("seq").alias("seq"))
    return dedup.confirmed_links(first)


@query("ddl_lookup_join", "SELECT conv_id, turn, l.source, l.docs FROM conversations c LEFT JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY source) l ON l.source = 'src' || CAST(conv_id % 25 AS VARCHAR)")
def ddl_lookup_join(spark, sf_dir):
    lookup = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")))
    return render.lookup(rows, lookup, "key", "source").select("conv_id", "turn", "source", "docs")


TARGETS = [("src0", 20_000), ("src1", 10_000), ("src2", 500_000), ("absent", 1_000)]
_TARGETS_SQL = "(VALUES " + ", ".join(f"({k}, '{s}', {t}::BIGINT)" for k, (s, t) in enumerate(TARGETS)) + ") AS c(ord, source, target)"


@query(
    "corpus_stats",
    f"""WITH s AS (SELECT c.ord, c.source, c.target, count(d.doc_id) > 0 AS present, count(d.doc_id) AS docs, CAST(coalesce(sum(length(d.text)), 0) AS BIGINT) AS chars FROM {_TARGETS_SQL} LEFT JOIN documents d USING (source) GROUP BY ALL),
t AS (SELECT *, chars // 4 AS approx_tokens FROM s)
SELECT source, present, docs, chars, approx_tokens, target AS target_tokens, round(100.0 * approx_tokens / (SELECT sum(approx_tokens) FROM t), 4) AS share_pct, round(approx_tokens / target, 4) AS actual_vs_target FROM t""",
)
def corpus_stats(spark, sf_dir):
    return stats.corpus_stats(_docs(spark, sf_dir), TARGETS).drop("ord")


@query("fertility", r"SELECT coalesce(source, 'overall') AS grp, docs, n_bytes, words, tokens, round(tokens / words, 6) AS tokens_per_word, round(n_bytes / tokens, 6) AS bytes_per_token FROM (SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(len(regexp_extract_all(text, '[^" + WHITE_SQL + r"]+'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (source))")
def fertility(spark, sf_dir):
    counted = _docs(spark, sf_dir).withColumn("tokens", F.regexp_count("text", F.lit("[a-zA-Z0-9]+")).cast("long"))
    return stats.fertility(counted, "source", ["tokens"]).select("grp", "docs", "n_bytes", "words", "tokens", F.round("tokens_per_word", 6).alias("tokens_per_word"), F.round("bytes_per_token", 6).alias("bytes_per_token"))


@query("fertility_eval_groups", r"SELECT grp, count(*) AS docs, CAST(sum(strlen(t)) AS BIGINT) AS n_bytes, CAST(sum(len(regexp_extract_all(t, '[^" + WHITE_SQL + r"]+'))) AS BIGINT) AS words FROM (SELECT 'conversations_' || role AS grp, text AS t FROM conversations UNION ALL SELECT 'benchmark_text', text FROM benchmark) WHERE trim(t) <> '' GROUP BY grp")
def fertility_eval_groups(spark, sf_dir):
    parts = [table(spark, sf_dir, "conversations").select(F.concat(F.lit("conversations_"), "role").alias("grp"), "text"), table(spark, sf_dir, "benchmark").select(F.lit("benchmark_text").alias("grp"), "text")]
    return stats.fertility(files.concat(*parts).where(F.trim("text") != ""), "grp", [], overall=None).select("grp", "docs", "n_bytes", "words")


@query("matched_margin", "SELECT source AS grp, a AS matched_tokens, b AS other_tokens, round((a - b) / b * 100.0, 6) AS margin_pct, a < b AS wins FROM (SELECT source, CAST(sum(len(regexp_extract_all(text, '[a-zA-Z]+'))) AS BIGINT) AS a, CAST(sum(len(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS BIGINT) AS b FROM documents GROUP BY source)")
def matched_margin(spark, sf_dir):
    counted = _docs(spark, sf_dir).withColumn("a", F.regexp_count("text", F.lit("[a-zA-Z]+")).cast("long")).withColumn("b", F.regexp_count("text", F.lit("[a-zA-Z0-9]+")).cast("long"))
    return stats.margins(stats.fertility(counted, "source", ["a", "b"], overall=None), "a", "b").select("grp", F.col("a").alias("matched_tokens"), F.col("b").alias("other_tokens"), F.round("margin_pct", 6).alias("margin_pct"), "wins")


@query("budget_cut", "SELECT doc_id AS seq, source FROM (SELECT *, coalesce(sum(length(text)) OVER w, 0) AS before, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE before < 40000 AND n < 15")
def budget_cut(spark, sf_dir):
    return sampling.within_budget(_docs(spark, sf_dir), 10_000, 15).select("seq", "source")


@query("holdout_mod_50")
def holdout_mod_50(spark, sf_dir):
    return _docs(spark, sf_dir).where(sampling.held_out(F.col("seq"), 50)).select("seq", "source")


_SAMPLED = "('0x' || sha256('7:' || CAST(doc_id AS VARCHAR))[1:16])::UBIGINT / 18446744073709551616.0 < 0.4"


@query("seeded_sample", f"SELECT doc_id AS seq FROM documents WHERE {_SAMPLED}")
def seeded_sample(spark, sf_dir):
    return sampling.sample(_docs(spark, sf_dir), "seq", 7, 0.4).select("seq")


@query("sample_complement", f"SELECT doc_id AS seq FROM documents WHERE NOT ({_SAMPLED}) ORDER BY doc_id LIMIT 100")
def sample_complement(spark, sf_dir):
    return sampling.complement(_docs(spark, sf_dir), "seq", 7, 0.4, limit=100).select("seq")


@query("first_documents", "SELECT doc_id AS seq FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark, sf_dir):
    return sampling.first(_docs(spark, sf_dir), "seq", 50).select("seq")


@query("first_by_source", "SELECT source, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS docs FROM documents GROUP BY source")
def first_by_source(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.min("seq").alias("first_doc"), F.max("seq").alias("last_doc"), F.count("*").alias("docs"))
