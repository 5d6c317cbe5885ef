"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for each operator."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import debruijn, images, latent, licences, packing, pii, quality, sketches, suffixes, url_rules
from sheaf.llm.repeats import union_of

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, node long, label int, rk long, a string, x string, words string, score string, marks string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, int(k))) for k in r.integers(2, 9, n))


PASSAGE = prose(1, 60)
NEAR = prose(2, 120)
TEXTS = [
    (0, None), (1, ""), (2, "word"), (3, "word"), (4, PASSAGE), (5, prose(3, 20) + " " + PASSAGE + " " + prose(4, 30)), (6, PASSAGE + "  \n " + PASSAGE),
    (7, NEAR), (8, NEAR + " more"), (9, NEAR.upper()), (10, prose(5, 9000)), (10, prose(6, 50)), (11, prose(7, 40)), (11, prose(7, 40)), (None, prose(8, 40)),
    (None, None), (12, "ß — ü 漢字 " * 60), (13, "a" * 900), (14, " \t\n "), (15, "mail a.b@c.de, +1 (555) 123-4567 or 4111 1111 1111 1111; 10.0.0.1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "a", "x", "w", "s", "m") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def covered(sequence, width):
    """Flags of what windows that occur twice cover, over all texts."""
    counts = Counter(tuple(s[k : k + width]) for s in sequence for k in range(len(s) - width + 1))
    out = []
    for s in sequence:
        flags = np.zeros(len(s), bool)
        for k in range(len(s) - width + 1):
            if counts[tuple(s[k : k + width])] > 1:
                flags[k : k + width] = True
        out.append(flags)
    return out


def test_suffix_dedup(spark, folder):
    got = Counter(map(tuple, suffixes.op5_suffix_dedup(spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    raws = [(t or "").encode() for _, t in TEXTS]
    want = Counter()
    for (i, _), raw, flags in zip(TEXTS, raws, covered(raws, 200), strict=True):
        kept = bytes(np.frombuffer(raw, np.uint8)[~flags])
        want[(i, len(raw), int(flags.sum()), int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffixes.op5_suffix_dedup(spark, f"{folder}/none").count() == 0


def test_groups_of_any_size(spark):
    """One scan for each anchor, a scan for each bin of it, and counting give the same bytes; groups list all places."""
    line = prose(9, 60)
    texts = [(k, prose(100 + k, 12) + line[k * 7 : 290 + k * 3] + prose(200 + k, 12)) for k in range(12)] + [(20, line), (21, line), (22, None), (23, "é" * 150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    raws = [(t or "").encode() for _, t in texts]
    want = {i: flags for (i, _), flags in zip(texts, covered(raws, 200), strict=True)}
    for direct, members in ((1024, 4096), (1, 4096), (1, 1)):
        rows, spans = suffixes.repeated_spans(docs, direct, members)
        for r in rows.join(spans, "rk", "left").collect():
            flags = np.zeros(len((r["text"] or "").encode()), bool)
            for s, e in union_of(r["marks"], len(flags)):
                flags[s:e] = True
            assert (flags == want[r["doc_id"]]).all(), (direct, members, r["doc_id"])
    groups, told = {}, {i: np.zeros(len(f), bool) for i, f in want.items()}
    by_id = dict(zip((i for i, _ in texts), raws, strict=True))
    for r in suffixes.repeat_groups(docs).collect():
        assert r["length"] >= 200
        groups.setdefault((r["anchor"], r["node"]), []).append((by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]], r["doc_id"], r["start"]))
        told[r["doc_id"]][r["start"] : r["start"] + r["length"]] = True
    assert all((told[i] == want[i]).all() for i in want)
    for places in groups.values():
        (text,) = {p[0] for p in places}
        everywhere = {(i, k) for i, raw in by_id.items() for k in range(len(raw)) if raw.startswith(text, k)}
        assert {p[1:] for p in places} == everywhere


def test_substring_dedup(spark, folder):
    got = Counter(map(tuple, debruijn.op10_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    split = [WORDS.findall(t or "") for _, t in TEXTS]
    want = Counter()
    for (i, _), words, flags in zip(TEXTS, split, covered(split, 35), strict=True):
        kept = " ".join(w for w, f in zip(words, flags, strict=True) if not f)
        want[(i, len(words), int(flags.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want
    assert debruijn.op10_substring_dedup(spark, f"{folder}/none").count() == 0


def test_union():
    assert union_of([{"pos": 5, "own": [{"low": -9, "high": 2}, {"low": 4, "high": 99}]}], 12) == [(0, 7), (9, 12)]
    assert union_of(None, 4) == []


def test_intervals():
    text = "banana$"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = np.array([-1, *[common(text[a:], text[b:]) for a, b in zip(order, order[1:])]])
    repeats = {text[order[first] : order[first] + depth] for depth, first, last in suffixes.lcp_intervals(lcp) if depth > 0}
    assert repeats == {"a", "ana", "na"}


def test_compaction(spark):
    edges = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 20, 11)], "edge long, source long, target long")
    got = {r["edge"]: (r["path"], r["rank"]) for r in debruijn.compacted(edges).collect()}
    assert got == {1: (1, 0), 4: (4, 0), 2: (2, 0), 3: (2, 1)}


def shingles(text):
    words = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def test_near_dedup(spark, folder):
    got = sketches.op7_minhash_near_dedup(spark, folder).collect()
    sets = [shingles(t) for _, t in TEXTS]
    group = list(range(len(TEXTS)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for (i, _), s, g in zip(TEXTS, sets, group, strict=True):
        ids = [k for (k, _), h in zip(TEXTS, group, strict=True) if h == g and k is not None] if s else [i]
        least = min((x for x in ids if x is not None), default=None)
        want[(i, len(s), least, i == least if least is not None else True)] += 1
    assert Counter(tuple(r) for r in got) == Counter({(a, b, c, bool(d) if a is not None else c is None): n for (a, b, c, d), n in want.items()})
    assert sketches.op7_minhash_near_dedup(spark, f"{folder}/none").count() == 0


def test_components_of_both_kinds(spark, monkeypatch):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))]
    edges = spark.createDataFrame(pairs, "x long, y long")
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {n: v for n, v in label.items() if any(a != b and n in (a, b) for a, b in pairs)}
    assert {r["node"]: r["label"] for r in sketches.components(edges).collect()} == want
    monkeypatch.setattr(sketches, "ONE_TASK_EDGES", 0)
    assert {r["node"]: r["label"] for r in sketches.components(edges).collect()} == want


def test_registers_estimate():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 1500
        both = int(round(2 * n * share / (1 + share)))
        x, y = sketches.registers(pool[:n]), sketches.registers(pool[n - both : 2 * n - both])
        got = sketches.likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - share) < 0.17
    assert np.array_equal(np.maximum(sketches.registers(pool[:900]), sketches.registers(pool[600:])), sketches.registers(pool))


def test_pii(spark, folder):
    rows = pii.op3_pii(spark, folder).collect()
    assert len(rows) == len(TEXTS)
    row = next(r for r in rows if r["doc_id"] == 15)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (0, 1, 2))
    assert pii.op3_pii(spark, f"{folder}/none").count() == 0


def plain_base(text):
    """The contract's base spans, by the patterns alone."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    return sorted(found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15])


def test_pii_base_spans_on_random_texts():
    r = np.random.default_rng(5)
    pieces = ["a", "b.c", "@", ".", "de", "1", "23", "456", " ", "-", "+", "(", ")", "255", "4111111111111111", "x@y.z", "\n", "é"]
    for _ in range(3000):
        text = "".join(pieces[k] for k in r.integers(0, len(pieces), int(r.integers(1, 30))))
        assert pii.base_spans(text) == plain_base(text), text


def test_tagger_learns_and_stays_off_prose():
    tagger = pii.trained()
    ids, labels = pii.training_windows(200, 77)
    scores = tagger.emissions(ids)
    assert np.mean([np.mean(tagger.decode(e) == y) for e, y in zip(scores, labels, strict=True)]) > 0.93
    _, every = pii.all_spans("ring (974) 555-3436 12 now", tagger)
    assert all(k == 3 for _, k, _ in every)
    assert pii.all_spans(PASSAGE, tagger) == ([], [])
    base, every = pii.all_spans("x " * 400 + "mail me: jo@ex.org " + "7 " * 900, tagger)
    assert set(base) <= set(every) and base == [(809, 0, 818)]


def test_quality(spark, folder):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(16)], "doc_id long, quality int")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i, _ in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert [r["score"] for r in quality.quality(docs, labels.limit(0)).collect()] == [1.0] * len(TEXTS)
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_discriminant_separates():
    r = np.random.default_rng(0)
    good, bad = [prose(k, int(r.integers(30, 200))) + "." for k in range(80)], [prose(k, 40).upper() + "!!" for k in range(80)]
    x = np.array([quality.statistics(t) for t in good + bad])
    means, factors, constants = [], [], []
    for own in (x[80:], x[:80]):
        cov = np.cov(own.T) + 0.02 * np.eye(x.shape[1])
        low = np.linalg.cholesky(cov)
        means.append(own.mean(0))
        factors.append(np.linalg.inv(low))
        constants.append(-np.log(np.diag(low)).sum())
    score = quality.Discriminant(np.array(means), np.array(factors), np.array(constants)).score(x)
    assert (score[:80] > 0.7).all() and (score[80:] < 0.7).all()


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.op8_best_fit_packing(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.op8_best_fit_packing(spark, f"{folder}/none").count() == 0


def test_packing_in_shards_and_special_tokens(spark):
    r = np.random.default_rng(1)
    pieces = spark.createDataFrame([(k, 0, 0, int(n), 1) for k, n in enumerate(r.integers(200, 1400, 600))], packing.PIECES)
    rows = packing.pack(pieces, shard_rows=100).toPandas()
    assert len(rows) == 600 and rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert rows["sequence_id"].nunique() <= 1.08 * rows["length"].sum() / 2048 + 1
    assert not rows.duplicated(["sequence_id", "offset"]).any()
    encode = packing._encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert 50256 in encode("a <|endoftext|> b")


def test_local_search_empties_bins():
    lengths = np.array([1100, 1100, 948, 900, 48, 2, 2, 2])
    bins = packing.local_search([[0, 3], [1, 4], [2, 5, 6, 7]], lengths, 2048)
    assert sorted(x for b in bins for x in b) == list(range(8)) and len(bins) <= 3


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (1, PASSAGE), (4, prose(99, 40)), (5, " ".join(PASSAGE.split()[:12]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in (4, 5, 6) for i in (1, 5)}
    words = PASSAGE.split()
    changed = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    more = spark.createDataFrame([(1, prose(50, 90) + " " + changed + " " + prose(51, 400)), (2, prose(52, 400))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in latent.contaminated(more, items.where("item_id = 1").limit(1)).collect()} == {(1, 1)}
    assert latent.contaminated(docs, items.limit(0)).count() == 0 and latent.contaminated(docs.limit(0), items).count() == 0


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequences():
    r = np.random.default_rng(0)
    for _ in range(300):
        a, b = r.integers(1, 9, int(r.integers(1, 90))), r.integers(0, 9, int(r.integers(0, 90)))
        assert latent.common_subsequence(latent._places(a), len(a), b.tolist()) == plain_common(a.tolist(), b.tolist())


def test_segments_hold_every_window(monkeypatch):
    monkeypatch.setattr(latent, "SEGMENT", 10)
    bounds = np.array([0, 0, 7, 38])
    text, start, end = latent.segments(bounds, 6)
    for t, (low, high) in enumerate(zip(bounds, bounds[1:])):
        for s in range(low, max(low, high - 6) + 1):
            assert any(a <= s and min(s + 6, high) <= b for k, a, b in zip(text, start, end) if k == t)
    assert (end - start).max() <= 16


def test_licences(spark, duck, docs, tmp_path):
    texts = [
        None, "", "Licensed under the Apache License, Version 2.0.", "x.\nReleased under the MIT License. All rights reserved.", "Licensed under CC BY-NC 4.0.\n" * 2,
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License. You may obtain a copy of the License at\nhttp", "This program is free software", "a" * 5000,
    ]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = licences.op4_license_scan(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(licences.ORACLE, str(tmp_path)).sort_values("doc_id").reset_index(drop=True)
    assert got.to_dict("records") == want.to_dict("records")
    assert got["licences"].tolist()[:6] == ["", "", "Apache-2.0", "MIT,all-rights-reserved", "CC-BY-NC-4.0,CC-BY-NC-4.0", "Apache-2.0"]
    assert licences.scan(docs).count() == len(TEXTS) and licences.scan(docs.limit(0)).count() == 0


def test_url_rules_of_both_kinds(spark):
    r = np.random.default_rng(2)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "aa.com", "com.a", ""]
    paths = ["/", "/en/", "/en/x", "/e", ""]
    rules = list({(hosts[h], paths[p]): v for h, p, v in zip(r.integers(0, 7, 14), r.integers(0, 5, 14), ["allow", "block"] * 7, strict=True)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "no scheme", "http://", *[f"http://{'www.' * int(w)}{hosts[h].upper() if w else hosts[h]}{paths[p]}?q=/en/" for w, h, p in zip(r.integers(0, 2, 60), r.integers(0, 7, 60), r.integers(0, 5, 60), strict=True)]]
    table = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rule_table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")

    def brute(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    for size in (1 << 20, 0):
        got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(table, rule_table, max_rule_bytes=size).collect()}
        assert got == {k: brute(u) for k, u in enumerate(urls)}
    assert url_rules.judge(table.limit(0), rule_table).count() == 0


def test_image_copies(spark):
    r = np.random.default_rng(4)
    vectors = [(int(100 * k + j), r_.tolist()) for k, r_ in enumerate(r.normal(0, 0.15, (12, 64))) for j in range(3)]
    rows = [*vectors, (5000, None), (5001, [0.0] * 64), (5002, [1.0] * 3), (5003, vectors[0][1]), (None, vectors[0][1])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").mapInArrow(images._rendered, "id long, width int, height int, pixels binary")
    got = [(x["id"], x["class_id"]) for x in images.copies(table.withColumn("label", F.lit(1)).withColumn("node", F.lit(2))).collect()]
    classes = dict(got)
    assert len(got) == len(rows)
    for k in range(12):
        assert {classes[100 * k + j] for j in range(3)} == {100 * k}
    assert classes[5003] == 0 and classes[None] == 0 and classes[5000] == 5000
    assert images.copies(table.limit(0)).count() == 0


def test_turned_images_are_linked():
    r = np.random.default_rng(8)
    image = np.kron(r.integers(20, 230, (10, 10)), np.ones((9, 9))).astype(np.uint8)
    _, bits, _ = images.keypoints(image)
    _, turned, _ = images.keypoints(np.rot90(image).copy())
    assert len({tuple(b) for b in bits.tolist()}) > 8 and len(turned) > 8
