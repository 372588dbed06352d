import random
import re

import pytest
from helpers import empty_docs, odd_docs

from quillon.llm import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text, kind, least):
    """(start, end, words) of the units."""
    words = [(m.start(), m.end(), "".join(c.lower() if c.isascii() else c for c in m[0])) for m in WORD.finditer(text)]
    pieces, held = [], []
    for k, (a, b, w) in enumerate(words):
        held.append((a, b, w))
        gap = text[b : words[k + 1][0]] if k + 1 < len(words) else "\n\n"
        if gap.count("\n") >= (2 if kind == "paragraph" else 1) or kind == "run" and w[-1] in ".!?":
            pieces.append(held)
            held = []
    if kind == "run":  # the shortest runs of pieces forward from each and back from each
        runs = []
        for i in range(len(pieces)):
            for way in (range(i, len(pieces)), range(i, -1, -1)):
                taken = []
                for j in way:
                    taken.append(j)
                    if sum(len(pieces[x]) for x in taken) >= least:
                        runs.append([w for x in sorted(taken) for w in pieces[x]])
                        break
        pieces = runs
    return {(p[0][0], p[-1][1], tuple(w for _, _, w in p)) for p in pieces if len(p) >= least}


def brute(rows, kinds, least):
    """{doc_id: merged spans that go}."""
    first, out = {}, {}
    found = {i: sorted(set().union(*(cut(t, k, least) for k in kinds))) for i, t in rows}
    for i in sorted(found):
        for a, b, w in found[i]:
            first.setdefault(w, (i, a, b))
    for i, spans in found.items():
        gone = set()
        for a, b, w in spans:
            j, x, y = first[w]
            if j != i:
                gone |= {(a, b)}
            elif x != a and max(a, y) < b:
                gone |= {(max(a, y), b)}
        merged = []
        for a, b in sorted(gone):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        if merged:
            out[i] = merged
    return out


@pytest.mark.parametrize("kinds", [("line",), ("paragraph",), ("run",), ("paragraph", "line", "run")])
def test_against_brute_force(spark, sf_dir, kinds):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    passage = "Ünë passage of some words, it goes on. And more of it here, much more than eight words! Short. Then a last one of nine words it is so."
    rows += [(1000 + i, f"own{i} words {rng.random()} {passage} tail{i} words.\n\n{passage}\nline {i}. A b. A b. A b. A b. A b. A b. A b. A b. A b.") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows, kinds, 8)
    out = substring_dedup.dedup(docs, kinds, min_words=8, longest=10**6).collect()  # no cuts inside sentences
    assert {r.doc_id: [tuple(s) for s in r.removed] for r in out if r.removed} == want and len(want) >= 8
    text = dict(rows)
    for r in out:
        if r.removed:
            joined = sorted([tuple(s) for s in r.removed] + [tuple(s) for s in r.kept])
            assert joined[0][0] == 0 and joined[-1][1] == len(text[r.doc_id]) and all(x[1] == y[0] for x, y in zip(joined, joined[1:]))
            assert r.text == "".join(text[r.doc_id][a:b] for a, b in r.kept)
        else:
            assert r.text == text[r.doc_id] and r.kept is None


def test_odd_rows(spark):
    rows = substring_dedup.dedup(odd_docs(spark).selectExpr("*", "1 AS rank", "2 AS key", "3 AS g_removed", "4 AS removed"), min_words=3).collect()
    assert len(rows) == 9 and sorted(str(r.doc_id) for r in rows if r.removed and r.doc_id != 7) == ["5", "5"]
    assert [r.text for r in rows if r.doc_id == 2] == [None] and rows[0].g_removed == 3
    assert substring_dedup.dedup(empty_docs(spark)).count() == 0
    with pytest.raises(Exception, match="no such kind"):
        substring_dedup.dedup(odd_docs(spark), ("word",)).collect()


def test_one_text_under_many_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(i, text) for i in range(60)] + [(None, text), (None, text), (61, text + " more"), (61, text)]
    out = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ("line",)).collect()
    assert [r.doc_id for r in out if r.removed is None] == [0, 61] and {r.text for r in out if r.doc_id not in (0, 61)} == {""}


def test_passage_after_different_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [[word() for _ in range(n)] for n in (3, 9, 4, 2, 12, 3, 20)]
    text = " ".join(" ".join(s) + "." for s in passage)
    poem = "\n".join(" ".join(word() for _ in range(3)) for _ in range(6))
    unstopped = " ".join(word() for _ in range(200))
    rows = [(i, "".join(f"{word()}. " for _ in range(i)) + f"{text} {' '.join(word() for _ in range(9 - i))}.\n{poem}\n{word()} {word()}\n{word()} {unstopped} {word()}") for i in range(6)]
    out = {r.doc_id: r.removed for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] is None
    for i, t in rows[1:]:
        gone = "\n".join(t[a:b] for a, b in out[i])
        assert text in gone and poem in gone
        assert len(set(unstopped.split()) & set(gone.split())) > 150
