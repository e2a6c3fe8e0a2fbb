"""Personal data: fixed patterns against plain expressions, the random field against enumeration."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from helpers import AWKWARD, by_id, documents

from surfacescan.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(m.start(), m.end(), k) for k, rx in PLAIN.items() for m in re.finditer(rx, text or "") if passes(k, m.group())]


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.examples())


def test_base_spans_on_random_texts():
    rng = np.random.default_rng(9)
    pieces = [*"0123456789", *"..@@--++ ()", "a", "Z", "é", "\n", "%", "255", "4539578763621486", "192.168.0.1", "+1 (743) 555-3824", "x@y.z", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.integers(1, 30)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "@" * 200_000, "." * 200_000 + "1", "1 " * 200_000, "9" * 5000 + ".1.1.1"):
        pii.base_spans(text)
        list(pii._sentences(text))


def test_viterbi_and_likelihood_by_enumeration():
    rng = np.random.default_rng(2)
    sentences = ["a 1@b", "+1 2", "", "x", "1.2"]
    t = pii.Tokens(sentences)
    features = t.features()
    model = pii.Model(rng.normal(size=(pii.FEATURES + 1, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    model.weights[pii.FEATURES] = 0
    scores, value, norm = model.scores(features), 0.0, 0.0
    got = pii.viterbi(scores, model.moves, t.bounds)
    labels = rng.integers(0, pii.LABELS, len(scores))

    def total(s, path):
        return sum(s[i, y] for i, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))

    for a, b in itertools.pairwise(t.bounds):
        if a == b:
            continue
        every = {p: total(scores[a:b], p) for p in itertools.product(range(pii.LABELS), repeat=b - a)}
        assert tuple(got[a:b]) == max(every, key=every.get)
        norm += np.log(np.exp(list(every.values())).sum())
        value += total(scores[a:b], labels[a:b])
    found, by_weight, by_move = pii.likelihood(model, features, labels, t.bounds)
    assert abs(found - (value - norm)) < 1e-8
    for x, g in ((model.weights, by_weight), (model.moves, by_move)):
        for at in [(0, 1), (3, 4), (8, 8), *map(tuple, np.argwhere(g != 0)[:5])]:
            old, both = x[at], []
            for d in (1e-5, -1e-5):
                x[at] = old + d
                both.append(pii.likelihood(model, features, labels, t.bounds)[0])
            x[at] = old
            assert abs((both[0] - both[1]) / 2e-5 - g[at]) < 1e-5


def test_held_out_sentences(model):
    rows = pii.examples(600, seed=1234)
    wanted = {(n, a, b, k) for n, (_, marked) in enumerate(rows) for k, a, b in marked}
    found = {x for x in model.spans([s for s, _ in rows]) if pii.plausible(x[3], rows[x[0]][0], x[1], x[2])}
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found & wanted) >= 0.96 * len(found)


def test_what_the_model_adds(model):
    def added(text):
        return [(k, text[a:b]) for a, b, k in pii.find_all([text], model)[0][1]]

    assert added("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert added("en çaux +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]
    assert ("card", "4539578763621486") in added("pay 4539578763621486 4539578763621486 or")
    assert added("mail bob.smith@mailhost today") == [("email", "bob.smith@mailhost")]
    for clean in ("License 4.0. Page 12 of 2024-01-02, 12:30:55", 'token = "a4a14da4dc9b206c0209041b0961df015c66b4f9" |', "id 1234567890 and 646cf2969054", "no numbers at all", "3. x @ y", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert added(clean) == []


def test_sentences_hold_every_hot_character():
    rng = np.random.default_rng(6)
    for _ in range(500):
        text = "".join(rng.choice(list("ab.!? \n1@é")) for _ in range(40))
        spans = list(pii._sentences(text))
        assert all(any(a <= i < b for a, b in spans) for i, c in enumerate(text) if c in "1@")
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(spans))
        ends = {m.end() - (m.group() != "\n") for m in re.finditer(r"\n|[.!?]\s", text)}
        assert all(not any(a < e < b for e in ends) for a, b in spans)


def test_table(spark, tmp_path, model):
    texts = [*AWKWARD, "é +1 (743) 555-3824, a@b.cc 10.0.0.1 4539578763621486", "(743) 555-3824 x@y", "x 1 " * 20_000, "퟿ 1 1.1.1.1"]
    docs = documents(spark, texts).withColumnRenamed("size", "spans").withColumnRenamed("slot", "n_card")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.query(spark, str(tmp_path))
    assert got.count() == docs.count()
    rows = by_id(got)
    for i, text in enumerate(texts):
        base, more = pii.find_all([text], model)[0]
        assert base == plain(text)
        r = rows[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for _, _, k in base) for x in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert r["spans"] == pii.listed(base + more) and r["n_added"] == len(more)
    assert pii.scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], f"text string, spans {pii.SPANS}")
    assert {r["n_added"] for r in pii.scan(docs, none).collect()} == {0}
    masked = by_id(pii.masked(docs))
    assert masked[len(AWKWARD)]["text"] == "é <phone>, <email> <ip> <card>" and masked[0]["text"] is None and masked[2]["text"] == AWKWARD[2]
