"""Operators that give one row a document: secrets, sharding, media, scoring, quality, mixing."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
from helpers import documents

from surfacescan.llm import language_model, mixing, mpeg, quality, secrets, sharding


def test_every_operator_takes_awkward_and_empty_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    for run in (secrets.scan, sharding.shard_rows, mixing.taken, language_model.score, lambda d: quality.score(d, labels), lambda d: mpeg.digests(mpeg.encode(d))):
        assert run(docs).count() == docs.count()
        assert run(docs.limit(0)).count() == 0


# ---- secrets


def brute(text):
    out = []
    for kind, rx, group, least in (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_base_spans():
    texts = ["token=token : abcdefg", "PASSWORD: 'hunter2x' é api-key=abcdef api_key=abcdefg", "AKIA" + "A1" * 8 + " AKIAAKIA" + "B2" * 8, "0123456789abcdef" * 2 + "g" + "ab" * 12, "ſecret=abcdefg passwd  =  \"a/b+c=\"", "secret:" + "f" * 30]
    for t in texts:
        base, _ = secrets.find(t)
        assert [f"{k}:{s}:{e}" for s, e, k in base] == brute(t)


def test_secrets_query_and_novelty(spark):
    key = "i0VpEBOWfbZAVaBSo63bbH6xnAbnBEoonCrbZINl"
    docs = documents(spark, [f"auth header {key}", "the secret of implementationDocumentation2020 is here", f"plain words {key}", "token=abcdefgh"], repeat=False)
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert rows[0]["spans"] == "novel:12:52" and rows[0]["n_assign"] == 0 and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[1]["spans"] == rows[2]["spans"] == "" and rows[3]["spans"] == "assign:0:14"
    masked = {r["doc_id"]: r for r in secrets.masked(docs).collect()}
    assert masked[3]["text"] == "<assign>" and masked[3]["n_chars"] == 8 and masked[2]["text"] == f"plain words {key}"
    assert secrets.masked(docs).columns == docs.columns


def test_long_secrets_are_reported_to_their_end():
    rng = np.random.default_rng(5)
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    drawn = lambda n: "".join(rng.choice(signs, n))
    head = "Authorization: Bearer "
    for n in (20, 255, 256, 257, 270, 600, 5000):
        text = f"{head}{drawn(n)} end"
        assert secrets.find(text) == ([], [(22, 22 + n, "novel")]) and secrets.mask(text) == f"{head}<novel> end"
    text = f"{head}{drawn(300)}/AKIA{'A1' * 8}/{drawn(300)} end"
    assert secrets.mask(text) == f"{head}<novel><access><novel> end"
    late = f"{head}{'z' * 300}{drawn(600)} end"
    assert secrets.mask(late) == f"{head}<novel> end"
    two = f"auth {drawn(12)}token{drawn(21)} {drawn(30)} end"
    assert secrets.mask(two) == "auth <novel> <novel> end"


def test_secrets_of_any_alphabet_before_and_after_the_word():
    import string

    rng = np.random.default_rng(8)
    for signs in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits + "+/"):
        for n in (20, 40, 200, 1000, 5000):
            key = "".join(rng.choice(list(signs), n))
            assert secrets.mask(f"the access token is {key} now") == "the access token is <novel> now"
            assert secrets.mask(f"{key} is the signature") == "<novel> is the signature" and secrets.mask(f"{key} {'far away ' * 9} token") == f"{key} {'far away ' * 9} token"
    for plain in ("implementationDocumentation2020", "user_account_description_number", "getAuthenticationTokenProviderFactory", "https://www.example.com/authorization/configuration/database", "x" * 300, "password-" * 40):
        assert secrets.mask(f"the token {plain} here") == f"the token {plain} here"


STYLES = (lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), "_".join, "-".join, "/".join, lambda w: "_".join(w).upper())


def test_names_of_known_words_stay_and_random_strings_go():
    """Both sides: at most 5 % of 2,000 names and paths of dictionary words are reported, and 95 % of random strings of each alphabet at least."""
    import string

    rng = np.random.default_rng(21)
    vocabulary = secrets.vocabulary(secrets.default_vocabulary()).split()
    own = ["".join(rng.choice(list("aeioulnrst"), rng.integers(5, 9))) for _ in range(400)]  # words that only the documents know
    hit = lambda s, words="": secrets.mask(f"the auth is {s} here", words) != f"the auth is {s} here"
    for source, words in ((vocabulary[-6000:], ""), (vocabulary, ""), (secrets.spoken(secrets.IDENTIFIERS).split(), ""), (own, " ".join(own))):
        names = []
        while len(names) < 2000:
            name = STYLES[len(names) % len(STYLES)]([source[i] for i in rng.integers(0, len(source), rng.integers(3, 7))])
            names += [name] if len(name) >= secrets.LEAST else []
        assert sum(hit(x, words) for x in names) <= 0.05 * len(names)
    hexes = string.digits + "ABCDEF"
    for signs in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", hexes, hexes.lower(), string.digits, string.ascii_uppercase + "234567"):
        drawn = ["".join(rng.choice(list(signs), n)) for n in [*range(20, 64), 100, 200, 600] * 4]
        assert sum(map(hit, drawn)) >= 0.95 * len(drawn), signs
    for text in ("see https://docs.example.org/guides/authentication/overview/getting-started.html for token auth", "signature org/apache/hadoop/mapreduce/lib/output/FileOutputFormat x"):
        assert secrets.mask(text) == text


def test_identifiers_come_from_all_documents_and_hold_no_candidates(spark):
    docs = documents(spark, ["zufallswort wiederholt"] * 5 + ["einmalig " + "q9Z" * 10, None, "abcdef " + "Q" * 25], repeat=False)
    assert secrets.identifiers(docs).split() == ["einmalig", "abcdef", "zufallswort", "wiederholt"]
    assert secrets.identifiers(docs, 1) == "wiederholt" and secrets.identifiers(docs.limit(0)) == ""
    name = "zufallswort_wiederholt_zufall"
    assert secrets.mask(f"token {name}", secrets.identifiers(docs)) == f"token {name}" and "<novel>" in secrets.mask(f"token {name}")


def test_repeated_secrets_do_not_hide_one_another():
    key = "i0VpEBOWfbZAVaBSo63bbH6xnAbnBEoonCrbZINl"
    for n in (1, 2, 3, 4, 5, 9):
        assert secrets.mask(f"Authorization: Bearer {key}\n" * n) == "Authorization: Bearer <novel>\n" * n


# ---- sharding


def test_sharding_law(spark):
    docs = documents(spark, [f"t{i % 7}" for i in range(203)])
    rows = sharding.shard_rows(docs, shards=10).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(r["row_number"] for r in rows) == list(range(len(rows)))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shard_rows(docs.repartition(3), shards=10)
    key = lambda rs: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in rs)
    assert key(rows) == key(again.collect())
    one = next(r for r in rows if r["doc_id"] == 3)
    assert one["size"] == 18 and one["text_crc32"] == zlib.crc32(b"t3")
    assert [r["shard"] for r in sharding.shard_rows(documents(spark, ["a"], repeat=False)).collect()] == [0]


# ---- media


def test_media_round_trip(spark):
    texts = ["", "a", "b" * 192, "c" * 1417, "é" * 3000, None]
    rows = {r["doc_id"]: r for r in mpeg.digests(mpeg.encode(documents(spark, texts, repeat=False))).collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        full = body + b" " * (max(1, math.ceil(len(body) / 192)) * 192 - len(body))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert rows[0]["media_sha256"] == rows[5]["media_sha256"]
    index = mpeg.index(mpeg.encode(documents(spark, texts, repeat=False))).where("doc_id = 4").first()
    assert index["duration_us"] == index["samples"] * 1_000_000 // 32000 and index["crc_bad"] == 0 and len(index["frame_offsets"]) * 1152 == index["samples"]


def test_media_damage_and_resync():
    whole = mpeg.pack(bytes(range(256)) * 40)
    s = mpeg.parse(whole)
    cut = s.offsets[2] + 300
    hurt = mpeg.parse(whole[:cut] + b"\xff\xfb\x00junk" + whole[cut:])
    assert len(hurt.offsets) == len(s.offsets) - 1 and hurt.skipped > 0
    flipped = bytearray(whole)
    flipped[s.offsets[1] + 10] ^= 1  # side information
    assert mpeg.parse(bytes(flipped)).crc_bad == 1
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 1000).offsets == [] and mpeg.parse(b"TAG" + bytes(125)).skipped == 0
    assert mpeg.parse(b"prefix" + whole).offsets[0] == s.offsets[0] + 6 and mpeg.unpack(whole + b"TAG" + bytes(125))[0] == bytes(range(256)) * 40
    assert s.vbr["frames"] == len(s.offsets) and mpeg.unpack(whole)[0] == bytes(range(256)) * 40


def bit_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1) ^ (0x8005 if (c >> 15) ^ int(b) else 0)
        c &= 0xFFFF
    return c


def protected_frame(layer, mode, bits, bitrate=8, version=3, rate=0):
    """A frame whose checksum covers its header's second half and `bits`, which open its body."""
    head = (0x7FF << 21 | version << 19 | (4 - layer) << 17 | bitrate << 12 | rate << 10 | mode << 4).to_bytes(4, "big")
    crc = bit_crc("".join(f"{b:08b}" for b in head[2:]) + bits).to_bytes(2, "big")
    h = mpeg.header(head)
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    return head + crc + body + b"\x55" * (h.size - 6 - len(body))


def test_media_checksums_of_every_layer():
    stereo1, joint1, mono1 = "0101" * 64, "0011" * (2 * 8 + 24), "1010" * 32
    table_b = [4] * 11 + [3] * 12 + [2] * 7
    alloc = "".join(("0001"[-w:] if i % 2 else "0" * w) * 2 for i, w in enumerate(table_b))
    joint = "".join(("0001"[-w:] if i % 2 else "0" * w) * (2 if i < 4 else 1) for i, w in enumerate(table_b))
    lsf = "".join("0001"[-w:] for w in [4] * 4 + [3] * 7 + [2] * 19)
    for layer, mode, bits, more in (
        (1, 0, stereo1, {}), (1, 4 + 1, joint1, {}), (1, 12, mono1, {}), (2, 0, alloc + "10" * 30, {"bitrate": 12}), (2, 4, joint + "01" * 30, {"bitrate": 12}),
        (2, 12, lsf + "11" * 30, {"version": 2}), (3, 0, "1" * 256, {}), (3, 12, "0" * 136, {}),
    ):
        frame = protected_frame(layer, mode, bits, **more)
        s = mpeg.parse(frame * 3)
        assert (len(s.offsets), s.crc_ok, s.crc_bad, s.skipped) == (3, 3, 0, 0)
        hurt = bytearray(frame * 3)
        hurt[len(frame) + 7] ^= 1
        assert mpeg.parse(bytes(hurt)).crc_bad == 1
        hurt = bytearray(frame * 3)
        hurt[2 * len(frame) - 3] ^= 1  # behind what the checksum covers
        assert mpeg.parse(bytes(hurt)).crc_ok == 3


def test_media_tags_and_tables():
    import struct

    whole, body = mpeg.pack(b"x" * 5000), bytes(range(256)) * 20
    s = mpeg.parse(whole)
    assert s.vbr_ok and not mpeg.parse(whole[: s.offsets[-1]]).vbr_ok
    id3v1 = (b"TAG" + b"Title".ljust(30, b"\0") + b"Someone".ljust(30) + b"Album".ljust(30, b"\0") + b"1999" + b"said".ljust(28, b"\0") + bytes([0, 7, 17]))
    item = struct.pack("<II", 4, 0) + b"Mood\0calm"
    ape = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, flags) + bytes(8)
    s = mpeg.parse(whole + ape(1 << 31 | 1 << 29) + item + ape(1 << 31) + id3v1)
    assert s.skipped == 0 and s.vbr_ok and s.tags == {"payload_bytes": "5000", "Mood": "calm", "title": "Title", "artist": "Someone", "album": "Album", "year": "1999", "comment": "said", "track": "7", "genre": "17"}
    old = b"ID3\x02\0\0\0\0\0\x0f" + b"TT2\0\0\x09" + b"\x01" + "hé".encode("utf-16") + b"\0\0"
    assert mpeg.parse(old + whole).tags["TT2"] == "hé"
    assert mpeg.unpack(mpeg.pack(body[:-128] + b"TAG" + body[-125:]))[0] == body[:-128] + b"TAG" + body[-125:]  # payload bytes are no tag
    frame = next(mpeg.pack(b"y" * 9000)[a:] for a in mpeg.parse(mpeg.pack(b"y" * 9000)).offsets)[:1440]
    frames = frame * 10
    for wrong in (0, 1):
        table = b"".join(struct.pack(">H", 1440 * 2) for _ in range(5))
        vbri = (frame[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1440 * 11, 10 + wrong, 5, 1, 2, 2) + table).ljust(1440, b"\0")
        s = mpeg.parse(vbri + frames)
        assert s.vbr["kind"] == "VBRI" and s.vbr["steps"] == [2880] * 5 and len(s.offsets) == 10 and s.vbr_ok == (not wrong)
    for junk in range(5000):
        mpeg.header(junk.to_bytes(4, "little"))
    assert mpeg.header.cache_info().currsize <= 4096 and mpeg.crc16.cache_info().currsize <= 1024


# ---- scoring


def test_language_model_against_counting(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{x}" for x in rng.zipf(1.6, 30) % 50) for _ in range(120)] + [None, ""]
    docs = documents(spark, texts, repeat=False)
    rows = {r["doc_id"]: r for r in language_model.score(docs, batch_text=4000).collect()}
    words = [(t or "").lower().split() for t in texts]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    counts, pairs = collections.Counter(), collections.Counter()
    for i, w in enumerate(words):
        if fold(i):
            counts.update([*w, None])
            pairs.update(zip(["<s>", *w], [*w, None]))
    n, v = sum(counts.values()), len(counts)
    for i, w in enumerate(words):
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9) and rows[i]["held_out"] == (fold(i) == 0)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n)
    # The model, by plain counting: estimates of three orders, weights from the deleted fold's histograms.
    grams = {}
    for i, w in enumerate(words):
        seq = ["<s>", "<s>", *w, None]
        for k in range(2, len(seq)):
            for order, g in ((1, (seq[k],)), (2, (seq[k - 1], seq[k])), (3, (seq[k - 2], seq[k - 1], seq[k]))):
                grams.setdefault(i, []).append((order, g))
    full = collections.Counter(g for i in grams if fold(i) for _, g in grams[i])
    rest = full - collections.Counter(g for i in grams if fold(i) == 1 for _, g in grams[i])

    def parts(i, c):
        seq, starts = ["<s>", "<s>", *words[i], None], c[(None,)]
        for k in range(2, len(seq)):
            one, two = (seq[k - 1],), (seq[k - 2], seq[k - 1])
            yield c[(seq[k],)], c[(seq[k - 1], seq[k])], starts if k == 2 else c[one], c[(seq[k - 2], seq[k - 1], seq[k])], starts if k == 2 else c[two]

    def histogram(w, order):
        out = collections.Counter()
        for i in grams:
            if fold(i) == 1:
                level, bins = language_model.ratio_bins(w, order, tuple(np.array(x, dtype=float) for x in zip(*parts(i, rest), strict=True)))
                out.update(zip(level.tolist(), bins.tolist(), strict=True))
        return [(a, b, m) for (a, b), m in out.items()]

    left = sum(m for g, m in rest.items() if len(g) == 1)
    weights = language_model.learn(float(left), v, histogram)
    assert 0 < weights.one < 1 and weights.two.max() > 0.05 and weights.three.max() > 0
    for i in range(len(texts)):
        want = 0.0
        for c1, c2, x1, c3, x2 in parts(i, full):
            p = weights.one * c1 / n + (1 - weights.one) / (v + 1)
            for lam, c, x in ((weights.two, c2, x1), (weights.three, c3, x2)):
                if x:
                    lam = lam[int(math.log2(x))]
                    p = (1 - lam) * p + lam * c / x
            want += math.log10(p)
        assert math.isclose(rows[i]["score"], want, rel_tol=1e-9)


def test_language_model_is_proper_and_uses_context():
    weights = language_model.mixture_weights([(3, 8 * 3, 100), (3, -language_model.REACH * language_model.BINS - 1, 5), (5, -8, 50)])
    assert 0.5 < weights[3] < 1 and weights[5] < 0.01 and weights[4] == weights[3] and weights[0] == 0
    brute = max(np.linspace(0, 1, 2001)[:-1], key=lambda w: 100 * math.log(w * 8 + 1 - w) + 5 * math.log(1 - w))
    assert abs(weights[3] - brute) < 2e-3


def test_held_out_scores_beat_the_base(spark):
    texts = [f"alpha beta gamma delta {'epsilon zeta' if i % 2 else 'eta theta'} iota" for i in range(200)]
    rows = [r for r in language_model.score(documents(spark, texts, repeat=False)).collect() if r["held_out"]]
    assert rows and all(r["score"] > r["base_score"] for r in rows)


# ---- quality


def test_quality_learns_and_reads_no_held_out_label(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"clean{i}" for i in range(40)], [f"junk{i}&&&" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 3 else bad, 25)) for i in range(400)]
    docs = documents(spark, texts, repeat=False)
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.score(docs, frame(labels)).collect()}
    held = [i for i in rows if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert sum(rows[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    assert {i: r["score"] for i, r in rows.items()} == {r["doc_id"]: r["score"] for r in quality.score(docs, frame(flipped)).collect()}
    assert {r["doc_id"] for r in quality.kept(docs, frame(labels)).collect()} == {i for i in rows if rows[i]["predicted"]}
    alone = quality.score(docs, frame([(1, 1, 0), (3, 1, 0), (5, None, 0)])).collect()
    assert len({r["score"] for r in alone}) == 1 and 0 <= alone[0]["score"] <= 1


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8) + (50 if i % 2 else 0)) for i in range(60)]
    ratio = np.ones(100)
    w, b, _ = quality.descend(rows, np.where(np.arange(60) % 2, 1.0, -1.0), ratio, np.full(60, 10.0), 50)
    assert all((w[x].sum() / len(x) ** 0.5 + b > 0) == bool(i % 2) for i, x in enumerate(rows))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows, ratio = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)], rng.normal(size=30)
    signs, c = rng.choice([-1.0, 1.0], 80), np.full(80, 0.7)
    w, b, alpha = quality.descend(rows, signs, ratio, c, 4000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = ratio[r] / len(r) ** 0.5, 1
    v = x.T @ (alpha * signs)  # the model that the dual variables stand for
    assert np.allclose(v[:30] * ratio, w) and np.isclose(v[30], b) and (alpha >= 0).all() and (alpha <= c).all()
    primal = v @ v / 2 + (c * np.maximum(0, 1 - signs * (x @ v))).sum()
    assert primal - (alpha.sum() - v @ v / 2) < 1e-2 * primal


def test_log_ratios_and_pattern_against_counting():
    rng = np.random.default_rng(2)
    rows, labels = [np.unique(rng.integers(0, 9, 5)) for _ in range(40)], rng.integers(0, 2, 40)
    got = quality.log_ratios(rows, labels)
    share = lambda s, y: (1 + sum(s in r for r, z in zip(rows, labels) if z == y)) / ((1 << quality.SLOTS_LOG2) + sum(len(r) for r, z in zip(rows, labels) if z == y))
    assert all(math.isclose(got[s], math.log(share(s, 1) / share(s, 0)), rel_tol=1e-9) for s in range(12))
    words = np.array([1, 1, 1, 2, 2, 3], dtype=np.uint64)
    runs = {"".join("01"[bool(i and words[i] == words[i - 1])] for i in range(a, a + n)) for n in (1, 2, 3, 4) for a in range(7 - n)}
    assert sorted(bin(int(c) - (1 << 20))[3:] for c in quality.pattern(words)) == sorted(runs)
    assert len(quality.pattern(words[:1])) == 1 and not len(quality.pattern(words[:0]))


def test_quality_takes_long_texts_and_bounds(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["bad!!", "junk", "%%"], 20)) for i in range(60)] + ["good fine " * 60_000]
    docs = documents(spark, texts, repeat=False)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(60, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert rows[60]["predicted"] == 1 and all(rows[i]["predicted"] == i % 2 for i in range(60))
    few = quality.score(docs, labels, sample=30, budget=400).collect()
    assert len(few) == 61 and len({r["score"] for r in few}) > 1
    assert {r["score"] for r in quality.score(docs, labels, budget=0).collect()} == {0.5}


# ---- mixing


def fill(sizes, share=1.5, epochs=2):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            return out | {s: weights[s] * level for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_mixing_targets_and_uses(spark):
    rng = np.random.default_rng(8)
    docs = documents(spark, [" ".join(["w"] * int(n)) for n in rng.integers(0, 900, 90)] + [None, " "], repeat=True)
    rows = mixing.taken(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = fill(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-9) and r["source_size"] == sizes[s] for r in rows if source[r["doc_id"]] == s)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(rows) == key(mixing.taken(docs.repartition(5)).collect())


def test_mixing_draws_against_brute_force(spark):
    docs = documents(spark, [" ".join(["w"] * (700 + 41 * i)) for i in range(60)], repeat=False)
    known = mixing.plan(mixing.sized(docs), block=8)
    q, w, size = {r["sid"]: r["q"] for r in known.table.collect()}, known.units, 37
    shards = -(-known.slots // size)
    want = collections.Counter()
    for shard in range(shards):
        n = size if shard < shards - 1 else known.slots - size * (shards - 1)
        ends, at = [], 0
        for sid in sorted(q):
            want[shard, sid] += n * q[sid] // w
            at += n * q[sid] % w
            ends.append((at, sid))
        for nth in range(1, at // w + 1):
            fell = int(hashlib.md5(f"mix-1-draw|{shard}|{nth}".encode()).hexdigest()[:15], 16) % at
            want[shard, next(s for e, s in ends if fell < e)] += 1
    got = {(r["shard"], r["sid"]): r["n"] for r in mixing.draws(known, size).collect()}
    assert got == {k: n for k, n in want.items() if n} and sum(got.values()) == known.slots and shards > 100
    spare = sum(size * x % w for x in q.values()) // w
    for sid, x in q.items():  # the mean is the share; the variance that of the residual draw
        n, p = np.array([got.get((s, sid), 0) for s in range(shards - 1)]), size * x % w / (spare * w)
        spread = spare * p * (1 - p)
        assert abs(n.mean() - size * x / w) < 4 * (spread / len(n)) ** 0.5 + 1e-9 and abs(n.var() - spread) < 0.35 * spread + 1e-9
    drawn = mixing.slots(known, size).collect()
    blocks, kept = {r["sid"]: r["blocks"] for r in known.table.collect()}, {}
    for shard, sid in sorted(got):  # a source's slots end with its last epoch's last block
        first = sum(got.get((s, sid), 0) for s in range(shard))
        kept[shard, sid] = min(got[shard, sid], 2 * blocks[sid] - first)
    assert collections.Counter((r["shard"], r["sid"]) for r in drawn) == {k: n for k, n in kept.items() if n > 0}
    for sid in q:
        mine = sorted((r["slot"], r["shard"]) for r in drawn if r["sid"] == sid)
        assert [s for s, _ in mine] == list(range(len(mine))) and [s for _, s in mine] == sorted(s for _, s in mine)


def test_mixing_takes_clashing_names_and_empty_mixes(spark):
    docs = documents(spark, ["a b c d", "e f"], repeat=False).selectExpr("*", "1 AS doc", "2 AS nth", "3 AS sid", "4 AS __size", "5 AS start", "6 AS `first.x`")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(r["text"].split()) for r in out.collect()) > 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(documents(spark, [None, " "], repeat=False)).count() == 0


def test_mixture_as_documents(spark):
    docs = documents(spark, [" ".join(f"d{i}w{k}" for k in range(50 + 37 * i)) for i in range(20)], repeat=False)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, uses = collections.Counter(), collections.Counter()
    for r in out.collect():
        words = r["text"].split()
        got[r["doc_id"]] += len(words)
        uses.update(words)
        assert r["n_chars"] == len(r["text"]) and all(w.startswith(f"d{r['doc_id']}w") for w in words)
    assert {i: n for i, n in taken.items() if n} == dict(got) and max(uses.values()) <= 2
    pieces = mixing.mix(docs).collect()
    for s in {p["source"] for p in pieces}:
        slots = {p["slot"] for p in pieces if p["source"] == s}
        assert slots == set(range(len(slots)))
