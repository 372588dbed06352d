import hashlib
import math
import re
from collections import Counter, defaultdict

from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from quillon.llm import pii, registry

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAMES = ["email", "ip", "card", "phone", "term"]
WORD = re.compile(r"[^\W_]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for m in EMAIL.finditer(text):
        out.append((m.start(), 0, m.end(), m[0]))
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), m[0]))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b, *_ in spans)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_terms(texts, window=100, support=3, at=0.8):
    pairs, of_pair, held, words = Counter(), defaultdict(set), Counter(), Counter()
    for text in texts:
        plain, base = fold(text), brute_base(text)
        hidden = list(plain)
        for a, _, b, _ in base:
            hidden[a:b] = " " * (b - a)
        hidden = "".join(hidden)
        mine, entities = set(), set()
        for a, k, b, v in base:
            name = (k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))
            entities.add(name)
            left, right = hidden[max(0, a - window) : a], hidden[b : b + window]
            left = re.sub(r"^[^\W_]+", "", left) if a > window else left
            right = re.sub(r"[^\W_]+$", "", right) if len(right) == window else right
            mine |= {(name, t) for t in WORD.findall(left + " " + right)}
        held.update(entities)
        pairs.update(mine)
        for p in mine:
            of_pair[p].add(text)
        words.update(set(WORD.findall(plain)))
    best = {}
    for (c, t), n in pairs.items():
        bits = math.log(len(texts) / held[c])
        if len(of_pair[c, t]) >= support and bits > 0:
            told = math.log(len(texts) * n / (held[c] * words[t])) / bits
            if told >= at - 1e-12:
                best[t] = max(best.get(t, 0), told)
    return best


HARD = [
    "a@b.c_d@e.f x@y@z.com .@-.- a@b a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3 9999999999999999999.1.1.1",
    "4111 1111-1111 1111 and 4111111111111111, 4111  1111 1111 1111, 79927398713, 00000000000000",
    "+1 (017) 555-7713. +12 +1----------5 +1234567890123456 ++49 30 1234567-",
    "𝒳 é 汉字 😀 me@example.com 😀 +49 170 1234567 10.0.0.1",
    "x" * 40_000 + " " + "9" * 40_000 + " " + "a@" + "b." * 20_000 + "c",
    "1-" * 30_000 + "@" * 500 + "+" * 500,
    "",
]


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    texts = HARD + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.base_spans(docs).select("doc_id", "base").collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    assert {k for spans in got.values() for _, k, _, _ in spans} == {0, 1, 2, 3}


def planted():
    """Nickname ``zorvex`` stands by one address in many texts, ``blinko`` mostly; common words stand by it too."""
    filler = ["the", "and", "with", "from", "this", "that"]
    texts = [" ".join(filler[(i + j) % 6] for j in range(30)) + f" end{i}" for i in range(120)]
    for i in range(5):
        texts[i] += f" Zorvex of the blinko crew{i} wrote from zo@mail.example.com this"
    texts[9] += " once zorvex came without it"
    texts[10] += " and blinko elsewhere"
    for i in range(20, 24):  # copies are one piece of evidence
        texts[i] = "copied words kwyjibo by 10.1.2.3 stand here"
    return texts


def test_terms_against_brute_force(spark, sf_dir):
    for texts in (planted(), [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + planted()):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        want = brute_terms(texts)
        got = {r.term: r.disclosure for r in pii.disclosing_terms(docs).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[t], want[t]) for t in want)
        assert {"zorvex", "blinko"} <= got.keys() and not {"kwyjibo", "the", "this"} & got.keys()


def test_find_and_sanitise(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs, remove_at=0.97).collect()}
    terms = brute_terms(texts)
    for i, text in enumerate(texts):
        extra = [(m.start(), 4, m.end(), m[0]) for m in WORD.finditer(fold(text)) if m[0] in terms]
        base = brute_base(text)
        extra = [e for e in extra if not any(s[0] < e[2] and e[0] < s[2] for s in base)]
        assert [tuple(s)[:4] for s in rows[i].spans] == sorted(base + extra)
    assert rows[9].sanitised.endswith(" once [WORD] came without it") and "[EMAIL]" in rows[0].sanitised
    assert "zo@" not in rows[0].sanitised and rows[50].sanitised == texts[50]
    assert rows[20].sanitised == "copied words kwyjibo by [IP] stand here"


def test_query_and_broadcast_bound(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, t) for i, t in enumerate([*planted(), *HARD])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.op12_pii(spark, str(tmp_path)).collect()
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(str, rows)) == sorted(map(str, registry.op12_pii(spark, str(tmp_path)).collect()))
    texts = [*planted(), *HARD]
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, text_of(base).split(","))) <= set(r.spans.split(","))


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark).withColumn("base", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("terms", F.lit(None))
    rows = pii.find(docs).collect()
    assert len(rows) == 9 and all(not r.spans and r.sanitised == r.text for r in rows)
    assert pii.find(empty_docs(spark)).count() == 0
