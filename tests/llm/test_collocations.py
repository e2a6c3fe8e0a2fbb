"""Phrase mining, against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents

from surfacescan.llm import collocations as cl

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chosen(f, totals, share, top):
    """Rows from exact counts by (lang, words)."""
    out = {}
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1}
    for (lang, w), a in phrases.items():
        if any(lang == o and len(x) > len(w) and 100 * b >= share * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (o, x), b in phrases.items()):
            continue
        score, k = min(((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for lang, rows in out.items() for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]


def plain(rows, least, share=80, top=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = tuple(x for x in re.split("[ \t]", piece) if x)
            totals[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    return chosen({k: n for k, n in f.items() if n >= least}, totals, share, top)


def held(df):
    return sorted((tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, word string, n long, rank int")


@pytest.mark.parametrize("bits", [cl.MOST_BITS, 1 << 15])
def test_against_plain_counts(spark, bits, monkeypatch):
    monkeypatch.setattr(cl, "MOST_BITS", bits)
    monkeypatch.setattr(cl, "BITS_EACH", 1)
    rng = np.random.default_rng(4)
    vocabulary = ["New", "york", "city", "of", "the", "é", "a", "\x85", "b　c", "z"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n"]) for _ in range(60)), rng.choice(["en", "de", "und", None])) for _ in range(60)]
    rows += rows[:5] + [(t, None) for t in AWKWARD] + [("new york city hall", "en")] * 9 + [("new york city hall " * 3000, "fr"), ("y" * 300_000 + " q", "fr")]
    got = held(cl.collocations(made(spark, rows), least=5))
    assert got == sorted(plain(rows, 5), key=repr) and len(got) > 50
    assert held(cl.collocations(made(spark, rows), least=5, share=101, top=3)) == sorted(plain(rows, 5, 101, 3), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en")], [("one", "en")] * 40, [("one two", "en")] * 29, [("one two", "en")] * 30, [(",;", "en")]])
def test_few(spark, rows):
    assert held(cl.collocations(made(spark, rows))) == sorted(plain(rows, 30), key=repr)


def test_production_table(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["text"], r["lang"]) for r in documents(spark).collect()]
    assert held(cl.query(spark, str(tmp_path))) == sorted(plain(rows, 30), key=repr)


def test_counts_past_64_bits(spark, monkeypatch):
    big = 2**62
    f = {("en", ("a",)): big, ("en", ("b",)): big - 5, ("en", ("c",)): big - 9, ("en", ("a", "b")): big - 7, ("en", ("b", "c")): big // 3, ("en", ("a", "b", "c")): (big - 7) * 4 // 5 - 1}
    rows = [(lang, " ".join(w), n) for (lang, w), n in f.items()] + [("en", "", 2**63 - 1)]
    monkeypatch.setattr(cl, "counts", lambda docs, least: spark.createDataFrame(rows, "lang string, phrase string, n long"))
    assert held(cl.collocations(None)) == sorted(chosen(f, {"en": 2**63 - 1}, 80, 2000), key=repr)
