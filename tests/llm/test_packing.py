import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import empty_docs, odd_docs
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.registry import op1_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(pieces, docs, window=2048):
    """Every id lies in one piece; windows are gapless; all but the last are full."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append((p.offset, p.length))
    for doc_id, text in docs:
        ids = reference_ids([text])[0]
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]]))
        assert sum(p.length for p in own) == len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for w, parts in by_window.items():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]]))
        assert sum(n for _, n in parts) == window or w == max(by_window)
    assert sorted(by_window) == list(range(len(by_window)))


def test_query_against_tokenizers(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pieces = op1_packing(spark, sf_dir).collect()
    check(pieces, docs)


def test_windows_show_the_target_mix(spark, sf_dir):
    source = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect())
    pieces = op1_packing(spark, sf_dir).collect()
    total, mixed = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[source[p.doc_id]] += p.length
        mixed[p.sequence_id][source[p.doc_id]] += p.length
    every = sum(total.values())
    for w in list(mixed)[:-1]:
        if w != max(mixed):
            for s, n in total.items():
                assert abs(mixed[w][s] - 2048 * n / every) <= 2


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 3.0, None: 1.0}])
def test_odd_rows(spark, weights):
    docs = odd_docs(spark)
    pieces = packing.pack(docs, RANKS, public_tokenizers.PATTERN, window=64, weights=weights).collect()
    by_doc = defaultdict(int)
    for p in pieces:
        by_doc[p.doc_id] += p.length
    rows = docs.collect()
    want = defaultdict(int)
    for r, ids in zip(rows, reference_ids([r.text for r in rows]), strict=True):
        want[r.doc_id] += len(ids)
    assert by_doc == want
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for w, parts in windows.items():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]]))
        assert sum(n for _, n in parts) == 64 or w == max(windows)


def test_empty(spark):
    assert packing.pack(empty_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_schedule_carries_over_blocks(seed, monkeypatch):
    """Any queues and weights: blocks join up, no queue goes backward, windows are full."""
    monkeypatch.setattr(packing, "BLOCK", 4)
    rng = np.random.default_rng(seed)
    held = rng.integers(1, 4000, size=rng.integers(1, 8)).tolist()
    weights = rng.random(len(held)) + 0.01
    plan = packing.Schedule(held, weights.tolist(), 32)
    rows = [plan.plan(b) for b in range(-(-plan.windows // 4))]
    for a, b in zip(rows, rows[1:]):
        assert (a[-1] == b[0]).all()
    served = np.concatenate([np.diff(r, axis=0) for r in rows])
    assert (served >= 0).all() and (served.sum(axis=1)[:-1] == 32).all()
    assert served.sum(axis=0).tolist() == held
    for q, n in enumerate(held):
        got = [x for part in plan.cuts(q, 0, n) for x in part[2].tolist()]
        assert sum(got) == n


def test_many_sources(spark, monkeypatch):
    """Sources beyond the number of own queues share some; a token lies in one piece all the same."""
    monkeypatch.setattr(packing, "SHARED", 3)
    rows = [(i, f"text {i} of " + "some words " * (i % 7), f"s{i % 40}" if i % 40 else None) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    pieces = packing.pack(docs, RANKS, public_tokenizers.PATTERN, window=64, own_queues=5).collect()
    check(pieces, [(i, t) for i, t, _ in rows], 64)


def test_ids_of_odd_texts():
    from quillon.llm._bpe import Encoder

    texts = ["don't we'll IT'S they're", "汉字 テスト 한국어 عربى", "a\u0301 \U0001f600\U0001f469\u200d\U0001f4bb emoji", " \t\n\r\n  trailing  ", "x" * 5000, "ab " * 20_000, "1234567 12.5% $3,000", "\u00a0\u2003wide\u3000spaces", "<|endoftext|> [PAD]", "a <|endoftext|><|endoftext|>b  <|endoftext|>", ""]
    got = Encoder(RANKS, public_tokenizers.PATTERN, packing.SPECIAL).encode(texts)
    assert [[*x, 1] for x in map(list, got)] == reference_ids(texts)
