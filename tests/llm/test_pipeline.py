import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from millrace.llm import quality_rank, simhash_golay
from millrace.llm.byte_bpe import parse_ranks
from millrace.llm.decontaminate import Scanner
from millrace.llm.pii_crf import find, labelled_rows, redact, train
from tests.llm.helpers import documents, empty, labels, table_dir

SF = "/root/testdata/sf0.001"


def brute(spark, sf):
    """The stages by plain loops over all rows (components by comparing every pair)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_rank.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = model.score(np.array([quality_rank.features((t or "").encode()) for _, t in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.7]
    prints, root = [simhash_golay.simhash((t or "").encode()) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    rows = [(i, t) for k, (i, t) in enumerate(rows) if least[top(k)] == i]
    scanner = Scanner([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])

    def clean(text):
        n, mask, _ = scanner.scan((text or "").encode())
        return not mask or 20 * mask.count(1) < n

    rows = [r for r in rows if clean(r[1])]
    field = train(labelled_rows())
    return {i: redact(t, spans) for (i, t), (_, spans) in zip(rows, find([t for _, t in rows], field))}


def test_equals_plain_loops(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(file.read()), special_tokens={})
    want = {i: (len(ids := library.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in brute(spark, SF).items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 100 < len(got) < 200


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog again and again until the night falls")], "item_id long, text string")
    sf = table_dir(tmp_path, spark, labels=labels(spark), benchmark=items)
    for start in (documents(spark), empty(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_entry_lists_all_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
