from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard import brute as brute_groups
from test_line_dedup import brute as brute_lines

from quillon.llm import mixing, toxicity
from quillon.session import table


def test_each_stage_against_a_plain_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]

    clean = stage["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    clean_rows = clean.collect()
    assert {r.doc_id for r in clean_rows} == {r.doc_id for r in docs.collect()} - bad

    cut = stage["line dedup"](spark, clean, sf_dir)
    assert cut.columns == columns
    rows = [(r.doc_id, r.text) for r in clean_rows]
    gone = brute_lines(rows, 20)
    want = {}
    for i, t in rows:
        lines = [x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])]
        if i not in gone or any(x.strip() for x in lines):
            want[i] = t if i not in gone else "\n".join(lines)
    cut_rows = cut.collect()
    assert {r.doc_id: r.text for r in cut_rows} == want and all(r.n_chars == len(r.text) for r in cut_rows if r.doc_id in gone)

    single = stage["n-gram Jaccard join"](spark, cut, sf_dir)
    assert single.columns == columns
    groups = brute_groups([(r.doc_id, r.text) for r in cut_rows], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}

    mixed = stage["mixing sources to target weights"](spark, single, sf_dir)
    assert mixed.columns == columns
    copies = {r.doc_id: r.copies for r in mixing.sample(single, mixing.words(F.col("text")), seed=corpus_pipeline.SEED).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(copies)

    pieces = stage["packing"](spark, mixed, sf_dir).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in single.collect()}
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    assert held == Counter({i: tokens[i] * n for i, n in copies.items() if n})


def test_stages_take_odd_and_no_rows(spark, sf_dir):
    from helpers import empty_docs, odd_docs

    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()
