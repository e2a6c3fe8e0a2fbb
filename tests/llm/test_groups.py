"""Operators over pairs and groups: neighbours, chat, packing, Jaccard join; and the pipeline."""

import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from helpers import AWKWARD, documents
from oracle import DATA, duck, rows

from surfacescan.llm import chat, graph, jaccard, neighbours, packing, registry

# ---- Jaccard join


def sets(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(texts):
    s, up = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and Fraction(len(s[i] & s[j]), len(s[i] | s[j])) >= Fraction(85, 100):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return [(len(x), u) for x, u in zip(s, up, strict=True)]


def near(rng, n, length, edits):
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits)):
            w[rng.integers(length)] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    shared = " ".join(f"p{i}" for i in range(70))
    texts = AWKWARD + near(rng, 40, 150, 9) + near(rng, 12, 40, 3) + [f"{t} {shared}" for t in near(rng, 10, 100, 40)] + ["Copy of A text with words"] * 5 + ["a b c", "A b  c", "a b d"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts, repeat=False)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_join_in_blocks_is_the_join(spark, monkeypatch):
    texts = near(np.random.default_rng(5), 30, 120, 8)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 600)
    for hub, task in ((500, 500), (10_000, 1000), (500, 30_000)):
        monkeypatch.setattr(jaccard, "HUB_ELEMENTS", hub)
        monkeypatch.setattr(jaccard, "TASK_ELEMENTS", task)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts, repeat=False)).collect()}
        assert [got[i] for i in range(len(texts))] == classes(texts)


def test_join_finds_links_far_from_the_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 900)
    monkeypatch.setattr(jaccard, "HUB_ELEMENTS", 300)
    monkeypatch.setattr(jaccard, "TASK_ELEMENTS", 300)
    rng = np.random.default_rng(15)
    shared = " ".join(f"p{i}" for i in range(40))  # candidates of one another, in few classes; and a chain, each link alone
    texts = [f"{t} {shared}" for _ in range(6) for t in near(rng, 4, 90, 5)]
    chain = [f"c{x}" for x in rng.integers(0, 10**6, 100)]
    for k in range(0, 60, 5):
        texts.append(" ".join([*chain[k:], *(f"t{i}" for i in range(k))]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts, repeat=False)).collect()}
    want = classes(texts)
    assert [got[i] for i in range(len(texts))] == want and max(Counter(c for _, c in want).values()) >= 8


def test_join_broadcasts_no_list_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MARKS", 2, raising=False)
    sent, broadcast = [], jaccard.F.broadcast
    monkeypatch.setattr(jaccard.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    texts = near(np.random.default_rng(21), 20, 100, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts, repeat=False)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    assert sent and max(sent) <= 2  # the candidates are many more


def test_marks_miss_no_id(spark, monkeypatch):
    rows = spark.range(-30_000, 30_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").union(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    ids = rows.where("doc_id % 7 = 0").selectExpr("doc_id AS node")
    for marks, most in ((1, 25_000), (64, 8_850)):
        monkeypatch.setattr(jaccard, "MARKS", marks)
        found = {r["doc_id"]: r["text"] for r in jaccard._marked(rows, ids).collect()}
        want = [i for i in range(-30_000, 30_000) if i % 7 == 0]
        assert all(found.get(i) == str(i) for i in want) and len(want) <= len(found) <= most
    assert jaccard._marked(rows, ids.limit(0)).count() == 0


def test_deduplicated_takes_clashing_names(spark):
    docs = documents(spark, ["x y z w v", "x y z w v", "other words here now"], repeat=False).selectExpr("*", "1 AS sig1", "2 AS `own`", "3 AS rep", "4 AS `a.b`", "5 AS __nth")
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_join_awkward_and_empty(spark):
    docs = documents(spark)
    assert jaccard.join(docs).count() == docs.count() and jaccard.join(docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each(spark):
    texts = AWKWARD + near(np.random.default_rng(6), 10, 80, 2) + ["x y z w v"] * 3
    docs = documents(spark, texts, repeat=False)
    out = jaccard.deduplicated(docs)
    want = {i for i, (n, c) in enumerate(classes(texts)) if not n or c == i}
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)
    assert jaccard.deduplicated(docs.union(docs)).where("text = 'x y z w v'").count() == 1


def test_tree_join_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(120):
        n = int(rng.integers(1, 25))
        bases = [rng.choice(60, size=rng.integers(5, 40), replace=False) for _ in range(3)]
        made = []
        for _ in range(n):
            s = set(bases[rng.integers(3)].tolist())
            for _ in range(rng.integers(0, 5)):
                s.symmetric_difference_update([int(rng.integers(80))])
            made.append(np.array(sorted(s), dtype=np.uint64))
        left = int(rng.integers(0, n))
        linked = {(i, j) for i in range(left or n) for j in range(left, n) if i != j and 100 * len(np.intersect1d(made[i], made[j])) >= 85 * max(1, len(np.union1d(made[i], made[j])))}
        got = jaccard.tree_join(made, left)

        def reach(edges):
            up = list(range(n))
            for a, b in edges:
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
            return up

        assert set(got) <= linked and reach(got) == reach(linked)


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5100)]
    up = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = up[a], up[b]
        if x != y:
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in up.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    # As a graph that one task does not take: rounds of stars, over tasks that hold few edges at a time.
    for most in (5, 120):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        df = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(5)
        assert {r["node"]: r["root"] for r in graph.components(df).collect()} == got


def test_marked_rows(spark):
    rows = spark.range(-500, 4000).selectExpr("id AS doc_id", "'t' AS text").union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    ids = spark.range(-500, 4000, 7).selectExpr("id AS node")
    got = {r["doc_id"] for r in jaccard._marked(rows, ids).collect()}
    assert {r["node"] for r in ids.collect()} <= got and len(got) < 700 and None not in got


# ---- neighbours


def vectors(spark, v):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 0, "c") for i, x in v], "vec_id long, embedding array<float>, label int, score string")


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 16)).astype(np.float32) + 4 * rng.normal(size=(30, 16)).astype(np.float32)[rng.integers(0, 30, 3000)]
    got = neighbours.search(vectors(spark, list(enumerate(v.tolist())))).collect()
    x, hit = v.astype(float), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best))
    assert hit >= 0.9 * 300


def test_neighbours_awkward(spark):
    rows_ = [(0, [1, 0]), (100, [1, 0]), (1, [1, 0]), (2, [0, 0]), (3, None), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, [1, 2, 3]), (None, [1, 1]), (8, [2, 0]), (8, [2, 0]), (200, [0, 0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(vectors(spark, rows_)).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, 1.0)]
    assert neighbours.search(vectors(spark, [(0, None)])).count() == 0


def test_neighbours_of_vectors_without_structure(spark):
    v = np.random.default_rng(11).normal(size=(2000, 24)).astype(np.float32)
    got = {}
    for r in neighbours.search(vectors(spark, list(enumerate(v.tolist()))), every=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x, hit = v.astype(float), 0
    for q in range(0, 2000, 50):
        d = ((x - x[q]) ** 2).sum(1)
        hit += len(got[q] & set([i for i in np.lexsort((np.arange(2000), d)) if i != q][:10]))
    assert hit >= 0.9 * 400


def test_neighbours_of_one_vector_repeated(spark, monkeypatch):
    # The copies fill several cells, and queries outnumber a batch.
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    v = [(i, [1.0, 2.0, 3.0] if i < 1500 else [float(i), 1.0, 0.0]) for i in range(2000)]
    got = {}
    for r in neighbours.search(vectors(spark, v), every=1, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all(sorted(got[q]) == [(n + 1, i, 0.0) for n, i in enumerate([i for i in range(4) if i != q][:3])] for q in range(1500))


def test_neighbours_window_follows_the_table(spark):
    rng = np.random.default_rng(5)
    share = {}
    for n in (1000, 30000):
        v = rng.random((n, 4))
        rows = neighbours.usable(vectors(spark, list(enumerate(v.tolist()))))
        index = neighbours.calibrate(neighbours.fit(v[:1000], n, 4), rows, np.arange(64), v[:64], n / 100, 10, 0.97, (4,))
        share[n] = index.reach / 1000
        lo, hi = index.windows(index.keys(v[:64]))
        assert (lo <= index.ranges(index.keys(v[:64]))).all() and (hi >= index.ranges(index.keys(v[:64]))).all()
    assert share[30000] < share[1000] / 4


def test_hilbert_is_a_continuous_bijection():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = neighbours.hilbert(cells, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


# ---- chat


def test_chat_collapse(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: [None], 7: [""]}
    turns = [(c, k, "user" if k % 2 == 0 else None, t, 1) for c, ts in talks.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, k int")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapsed(df.repartition(4)).collect()}
    assert set(got) == {2, 4, 5, 6, 7} and got[2] == (3, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert chat.collapsed(df.limit(0)).count() == 0


def test_chat_awkward(spark):
    """Null ids, null and tied turns, repeated rows, a very long text and clashing columns: as the docstring says."""
    long = "x" * 3_000_000
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (1, 0, "user", "a"), (1, None, "sys", "first"), (2, 5, "b", "t"), (2, 5, "a", "t"), (2, 5, "a", None), (3, 0, "user", "r"), (3, 0, "user", "r"), (4, 0, "user", "r"), (5, 0, "user", long), (6, 0, "user", long), (6, 1, "bot", "y")]
    df = spark.createDataFrame([(*r, 1, "h", 2, "r") for r in rows], "conv_id long, turn long, role string, text string, n long, h1 string, K int, rendered string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapsed(df.repartition(5)).collect()}
    say = lambda *turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    assert got == {
        None: (2, say(("user", "a"), ("user", ""))), 1: (2, say(("sys", "first"), ("user", "a"))), 2: (3, say(("a", ""), ("a", "t"), ("b", "t"))), 3: (2, say(("user", "r"), ("user", "r"))), 6: (2, say(("user", long), ("bot", "y"))),
    }


# ---- packing


def test_packing_places_everything(spark):
    rng = np.random.default_rng(9)
    docs = documents(spark, AWKWARD + [" ".join(f"w{x}" for x in rng.integers(0, 300, n)) for n in rng.integers(1, 900, 60)])
    got = packing.pack(docs).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    plain = {r["doc_id"]: [*encoder.encode([r["text"] or ""])[0], 0] for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in got:
        if r["doc_id"] is not None:
            ids = plain[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    bins: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):  # first fit, longest first
        i = next((k for k, b in enumerate(bins) if b + n <= 2048), None)
        bins = [*bins, n] if i is None else [*bins[:i], bins[i] + n, *bins[i + 1 :]]
    assert len(by) <= len(bins)
    assert packing.pack(docs.limit(0)).count() == 0


def test_stretches_of_white_space_do_not_merge():
    import pyarrow as pa

    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["Foo\n", "Foo\n\nBar", "a b  ", "a  c", "x\n\n\n", "y\n \n\tz", " ", "   q", "e\xa0", "e\n\n\nf", "g　", "\n\n", "\n\n\n\nh"]
    assert encoder.compiled
    for order in (texts, texts[::-1], [t for t in texts for _ in "12"], *([x, y] for x in texts for y in texts)):
        encoder._clear()
        got = [x.tolist() for x in encoder.documents(pa.array(order))]
        assert got == [[*ids, packing.END] for ids in encoder.encode(order)]


def test_ids_are_the_tokenizers_own():
    import pyarrow as pa

    encoder, rng = packing.Encoder(packing.default_tokenizer()), np.random.default_rng(31)
    parts = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\xa0", "\u3000", "\u2028", "\x85", "a", "the", "Bar", "don't", "'s", "12", "3.5", "é", "漢字", "😀", "!!", "--", "_x", "\0", "e\u0301"]
    for _ in range(8):  # batches of a kept cache
        texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(400)]
        got = [x.tolist() for x in encoder.documents(pa.array(texts))]
        assert got == [[*ids, packing.END] for ids in encoder.encode(texts)]


def test_the_program_packs_small_tables_too():
    rng = np.random.default_rng(12)
    for n in (1, 2, 30, 300, 3000):
        need = np.bincount(np.clip(rng.lognormal(5, 1, n).astype(int) + 1, 1, 512), minlength=513)
        both = {k: sum(t for _, t in v) for k, v in packing.packings(need, 512).items()}
        assert sum(t for _, t in packing.plan(need, 512)) == min(both.values()) and both["program"] <= both["greedy"] * 1.02 + 1
        for chosen in packing.packings(need, 512).values():
            made = np.zeros_like(need)
            for config, times in chosen:
                for x, k in config:
                    made[x] += k * times
            assert (made == need).all()


@pytest.mark.parametrize("scale", [1, 40])
def test_plan_packs_exactly(scale):
    rng = np.random.default_rng(scale)
    need = np.bincount(np.clip(rng.lognormal(4.5, 1, 600 * scale).astype(int) + 1, 1, 256), minlength=257)
    chosen = packing.plan(need, 256)
    made = np.zeros_like(need)
    for config, times in chosen:
        assert sum(x * k for x, k in config) <= 256 and times > 0
        for x, k in config:
            made[x] += k * times
    used, least = sum(t for _, t in chosen), -(-int((need * np.arange(257)).sum()) // 256)
    assert (made == need).all() and used <= least * 1.01 + 2 and used <= sum(t for _, t in packing.greedy(need, 256))


def test_knapsack_and_cuts():
    value = np.full(11, -np.inf)
    value[[3, 4, 7]] = [3.0, 4.5, 7.0]
    best, _ = packing.knapsack(value, 10)
    assert best[10] == 3.0 + 3.0 + 4.5 and best[8] == 9.0 and best[2] == 0
    assert packing.cuts(5, 10) == [0] and packing.cuts(10, 10) == [0] and packing.cuts(20, 10) == [0, 10] and packing.cuts(25, 10) == [0, 5, 15]


# ---- oracle and pipeline


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    ours, theirs = registry.queries()[name](spark, f"{DATA}/sf0.001").toPandas(), duck(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_pipeline(spark):
    import corpus_pipeline
    from surfacescan.llm import quality, secrets
    from surfacescan.llm.common import materialise

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = materialise(corpus_pipeline.keep_quality(spark, docs, sf), "t")
    good = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == good and kept.columns == docs.columns
    alone = materialise(corpus_pipeline.drop_near_copies(spark, kept, sf), "t")
    pdf = kept.orderBy("doc_id").toPandas()
    want = [c for _, c in classes(list(pdf.text))]
    assert {r["doc_id"] for r in alone.select("doc_id").collect()} == {int(pdf.doc_id[i]) for i, c in enumerate(want) if c == i}
    safe = materialise(corpus_pipeline.mask_secrets(spark, alone, sf), "t")
    assert safe.count() == alone.count() and secrets.scan(safe).agg({"n_access": "sum"}).first()[0] == 0
    mixed = materialise(corpus_pipeline.mix_sources(spark, safe, sf), "t")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixing", "packing"]


def test_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    from surfacescan.llm.common import materialise

    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = documents(spark)
    for start in (whole, whole.limit(0)):
        docs = materialise(start, "t")
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, docs, str(tmp_path)), "t")
            assert name == "packing" or out.columns == whole.columns
            if name in ("quality", "secrets"):
                assert out.count() == docs.count()
            docs = out
        assert (docs.count() > 0) == (start is whole)


def test_near_copies_stage_links_from_four_fifths(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    texts = []
    for added in (54, 60, 72):  # five-word similarity 0.846, 0.831, 0.804
        base = words(300)
        texts += [base, f"{base} {words(added)}"]
    base = words(300)
    texts += [base, f"{base} {words(80)}"]  # 0.787
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, texts, repeat=False), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 6, 7]
