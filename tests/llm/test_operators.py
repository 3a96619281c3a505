"""The ten operators against brute-force versions, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mangrove.llm import bpe, exact_dedup, language, licenses, line_dedup, media, mixing, queries, sharding, shingles, simhash, toxicity
from mangrove.llm.components import connected_components
from tests.conftest import SMALL, same_rows
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self, n):
        self.root = list(range(n))

    def top(self, i):
        while self.root[i] != i:
            i = self.root[i]
        return i

    def join(self, i, j):
        a, b = self.top(i), self.top(j)
        self.root[max(a, b)] = min(a, b)


# SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(name, spark, duck):
    same_rows(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], duck)


# mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by the stated rule, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(open_, key=str):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_ = open_ - {s}
    return target


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORDS.findall(text or ""))
    want, taken, most = fill(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1, (s, taken[s], want[s], most[s])


def test_mixing(make):
    docs = [(i, "w " * (1 + i * 7 % 23), ("b", "a", None, "c", "é")[min(i % 9, 4)]) for i in range(400)]
    docs += [(1000 + i, "v " * 40, "tiny") for i in range(2)] + [(2000, "", "none"), (2001, None, "none")]
    table = make([(i, t, s) for i, t, s in docs])
    rows = mixing.plan_mix(table).collect()
    check_mix(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(table.repartition(7)).collect()))
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mixing_salted_join(make, monkeypatch):
    from mangrove.llm import common

    table = make([(i, "w " * (i % 9 + 1), f"s{i % 5}") for i in range(100)])
    want = sorted(map(str, mixing.plan_mix(table).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert sorted(map(str, mixing.plan_mix(table).collect())) == want


# simhash


def brute_fingerprint(text):
    words = WORDS.findall(lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    f, links = np.array(prints, dtype=np.uint64), Union(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            links.join(i, int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[links.top(i)] = min(least.get(links.top(i), 1 << 62), d)
    return sorted((str(d), format(p, "016x"), str(least.get(links.top(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_simhash(make):
    base = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear in the dark forest at night".split() * 6
    rows = [(i, " ".join([*base[:-1], f"end{i % 7}"])) for i in range(60)] + [(100 + i, f"text number {i} of its own kind with some words {i * i}") for i in range(60)]
    rows += [(i, t) for i, t in ODD if t is None or len(t) < 5000]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op2_query(make(rows)).collect())
    assert got == brute_groups(rows)


def test_simhash_cuts_large_shards(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (300, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    groups = lambda **how: sorted(map(tuple, connected_components(simhash.link_fingerprints(df, **how)).collect()))
    ordered = sorted(values)
    links = Union(len(ordered))
    for i, x in enumerate(ordered):
        for j in range(i):
            if (x ^ ordered[j]).bit_count() <= 4:
                links.join(i, j)
    sizes = Counter(links.top(i) for i in range(len(ordered)))
    want = sorted((v, ordered[links.top(i)]) for i, v in enumerate(ordered) if sizes[links.top(i)] > 1)
    for picked in (1, 2, 3):
        got = [(v, c) for v, c in groups(picked=picked, tree_nodes=16)]
        assert sorted(set(got) | {(c, c) for _, c in got}) == want


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (100, 200)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[300] == got[200] == 100


# licenses


def test_licenses(make):
    texts = [
        "Released under the MIT License. mit license MIT, license!", "mitlicense mit", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "General Public", "", None,
        "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files",
        "MİT license mit license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.op3_query(make(rows + rows[:1])).collect()}
    for i, text in rows:
        words = re.findall(licenses.WORDS, lower(text))
        starts = [(k, label) for label, phrase in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=(None,))[0], max(starts, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({x for _, x in starts})) and 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert [got[i].labels for i in (0, 2, 3, 4, 5, 8, 10)] == ["mit", "apache", "gpl", "cc-by-nc", "", "mit", "bsd"]


# sharding


def brute_place(n, total, shards=40):
    a = max(1, math.isqrt(total - 1) + 1 if total else 1)
    b = -(-total // a)

    def mix(x, k):
        y = ((x % sharding.PRIME) * (sharding.SEED + 7_919 * k) + 104_729 * (k + 1)) % sharding.PRIME
        return ((y * y) % sharding.PRIME * 48_271 + y) % sharding.PRIME

    def once(x):
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            if k % 2:
                right = (right + mix(left, k)) % b
            else:
                left = (left + mix(right, k)) % a
        return left * b + right

    p = once(n)
    while p >= total:
        p = once(p)
    return p % shards, p // shards


@pytest.mark.parametrize("n", [1, 2, 3, 39, 41, 500, 1001])
def test_sharding(make, n):
    rows = sharding.shard_documents(make([(i, f"text {i}") for i in range(n)])).collect()
    order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    want = {i: brute_place(k, n) for k, i in enumerate(order)}
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(f"text {r.doc_id}") + 16 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
    counts = [len(by[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


# exact duplicates


def test_exact_dedup(make):
    rows = [(i, f"t{i % 9}" * (i % 4)) for i in range(80)] + ODD
    got = exact_dedup.exact_duplicates(make(rows), capacity=64).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((str(i), str(keep), len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_exact_dedup_chains_colliding_keys(make, monkeypatch):
    """Texts that share a key stand in its chain, in the one bucket of the key, and are still told apart."""
    monkeypatch.setattr(exact_dedup, "_key", lambda text: F.shiftleft((F.length(text) % 3).cast("long"), 61))
    rows = [(i, f"t{i % 9}" * (i % 5)) for i in range(80)] + ODD
    docs = make(rows)
    got = exact_dedup.exact_duplicates(docs, capacity=4).collect()
    most = {}
    for i, t in rows:
        most[t or ""] = max(most.get(t or "", -1), -1 if i is None else i)
    assert sorted((str(r.doc_id), str(r.keep_id), r.text_sha256) for r in got) == sorted((str(i), "None" if most[t or ""] < 0 else str(most[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    _, index = exact_dedup.build_index(docs, capacity=4)
    index = index.withColumn("file", F.input_file_name())
    chains = index.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("chain").alias("places"), F.countDistinct("prefix", "local_depth").alias("buckets"), F.countDistinct("file").alias("files")).collect()
    assert len(chains) == 3 and all(r.n == r.places > 1 and r.buckets == 1 and r.files == 1 for r in chains)


def test_directory_splits(spark):
    keys = spark.range(10_000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(2000).select(F.shiftleft("id", 48).alias("key")))
    buckets = exact_dedup.directory(keys, capacity=200)
    found = exact_dedup._bucketed(keys, buckets)
    per = found.groupBy("local_depth", "prefix").count()
    assert found.count() == 12_000 and per.agg(F.max("count")).first()[0] <= 200 and per.count() == buckets.count() > 60
    assert len({r.local_depth for r in buckets.collect()}) > 1
    assert exact_dedup.directory(spark.range(1000).select(F.lit(5).cast("long").alias("key")), capacity=10).count() == 1


# BPE


def test_bpe(make, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocab())
    texts = [t or "" for _, t in ODD] + ["a<|endoftext|> b<|endoftext|>", "aaaaaaa aaa\t\t x", "I'll don't  'S ½²٣", "Thananan Toanananwh ededed"]
    rows = list(enumerate(texts)) + [(1000 + r.doc_id, r.text) for r in small.collect()]
    got = {r.doc_id: r for r in bpe.encode_documents(make(rows)).collect()}
    digest = {r.doc_id: r for r in bpe.op6_query(make(rows)).collect()}
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids) == digest[i].n_tokens
        assert digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# toxicity


def test_bpe_in_small_pieces():
    """Smaller pieces and a smaller cache give the same tokens; the cache holds its bound and one piece at most."""
    with open(bpe.default_vocab(), "rb") as file:
        vocab = type("Vocab", (), {"value": file.read()})
    texts = [" ".join(f"w{i}x{k * i}" for k in range(40)) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    got = []
    for sizes in ((), (500, 100)):
        bpe._coder.clear()
        got.append([r for out in bpe._encoder(vocab, "v", True, True, *sizes)([batch]) for r in out.to_pylist()])
        held = len(bpe._coder["v"].ids_text)
    assert got[0] == got[1] and held < 600


def test_fold():
    assert toxicity.fold("You 1d10t! сlown s7upid te$$$ the### l0ser 1999 идиот") == " you idiot clown stupid te the loser идиот "
    assert toxicity.fold(None) == "  " and toxicity.fold("ＩＤＩＯＴ") == " idiot "


def test_exception_phrases():
    model = toxicity.Model({" scum ": 5.0, " idi": 3.0}, ["pond scum"], (1.0, 1.0, -2.0))
    hits = toxicity.Matcher(model).hits
    assert hits(toxicity.fold("pond scum")) == [] and len(hits(toxicity.fold("scum pond scum idiom"))) == 2


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op7_query(docs, labels).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(rows) == docs.count() and sum(r.predicted == known[r.doc_id] for r in held) / len(held) >= 0.93
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.op7_query(docs, flipped).collect())) == sorted(map(str, rows))


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op7_query(make(ODD), none).collect()} == {0.0}


# language


def test_language_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language.op8_query(docs).collect()}
    held = [(rows[r.doc_id], r) for r in docs.collect() if rows[r.doc_id].held_out]
    assert sum(a.lang_pred == b.lang for a, b in held) / len(held) >= 0.96
    shuffled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in language.op8_query(shuffled).collect()} == {r.lang_pred for r in rows.values()}


def test_language_letters():
    c = language.Classifier({"en": b"the cat sat on the mat", "de": b"die katze sass auf der matte"})
    assert [c.classify(t)[0] for t in (None, "", "12 ½ ² _", "the cat", "die katze auf")] == ["und", "und", "und", "en", "de"]
    assert language.Classifier({}).classify("x") == ("und", 0.0, True) and language.Classifier({"en": b"x"}).classify("y") == ("en", 1.0, False)


def test_language_odd(odd):
    got = {(r.doc_id, r.lang_pred) for r in language.op8_query(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= got and (4, "en") in got


# media


def test_lzw():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"a" * 9000, rng.bytes(30_000), bytes(rng.integers(0, 2, 60_000, dtype=np.uint8)), bytes(range(256)) * 200):
        assert media.lzw_decode(media.lzw_encode(data), 8) == data
    small = bytes(rng.integers(0, 4, 20_000, dtype=np.uint8))
    assert media.lzw_decode(media.lzw_encode(small, 2), 2) == small
    with pytest.raises(ValueError):
        media.lzw_decode(b"\x00\x01", 8)


def gif(frames, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff", size=(2, 2)):
    """A GIF of (indices, w, h, left, top, disposal, transparent, delay, interlaced) frames."""
    u16 = lambda v: v.to_bytes(2, "little")
    out = b"GIF89a" + u16(size[0]) + u16(size[1]) + b"\x91\0\0" + palette
    for indices, w, h, left, top, disposal, transparent, delay, interlaced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + u16(delay) + bytes([transparent or 0, 0])
        out += b"\x2c" + u16(left) + u16(top) + u16(w) + u16(h) + bytes([0x40 * interlaced]) + b"\x02" + media._blocks(media.lzw_encode(bytes(indices), 2))
    return out + b"\x3b"


def test_gif_rules():
    shown = []
    frames = [([1, 1, 1, 1], 2, 2, 0, 0, 1, None, 5, 0), ([2, 0], 2, 1, 0, 0, 3, 0, 7, 0), ([3], 1, 1, 1, 1, 2, None, 9, 0), ([2], 1, 1, 0, 0, 0, None, 1, 0)]
    for f in media.decode_gif(gif(frames)):
        shown.append([tuple(int(v) for v in p) for row in f.rgba for p in row])
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, blue], [green, red, red, clear]]
    rows = next(media.decode_gif(gif([([i % 4 for i in range(10)], 1, 10, 0, 0, 0, None, 1, 1)], size=(1, 10)))).canvas[:, 0]
    plain = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]  # the row each sample belongs to
    first = next(media.decode_gif(gif([([i % 4 for i in range(4)], 1, 4, 0, 0, 0, None, 1, 0)], size=(1, 4)))).canvas[:, 0]
    assert [int(rows[r]) for r in plain] == [int(first[i % 4]) for i in range(10)]
    with pytest.raises(ValueError):
        list(media.decode_gif(b"PNG"))


def test_media(odd):
    want = {}
    for i, text in ODD:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[i, len(raw)] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    rows = media.op9_query(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id, r.n_bytes] and r.feature
    frames = media.read_frames(media.store(odd.where("doc_id = 7"))).orderBy("frame_no").collect()
    assert len(frames) == -(-(len(ODD[9][1]) // 576 + 1) // 64) and [f.start_cs for f in frames] == [10 * k for k in range(len(frames))]
    assert all(sum(f.histogram_red) == f.width * f.height for f in frames) and len(frames[0].pixels) == 4 * frames[0].width * frames[0].height


# lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = int(rng.integers(0, len(text)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            text[k] = "é"
        elif kind == 1:
            text.insert(k, "q")
        else:
            text.pop(k)
    return "".join(text)


def test_within_edits():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = "".join(rng.choice(list("ab"), int(rng.integers(0, 9))))
        b = changed(rng, a, int(rng.integers(0, 4))) if len(a) > 4 else a[:2]
        for e in (0, 1, 2, 3):
            assert line_dedup.within_edits(a, b, e) == (edits(a, b) <= e), (a, b, e)


def test_probes_meet_segments():
    rng = np.random.default_rng(4)
    for _ in range(1000):
        a = "".join(rng.choice(list("abcd"), int(rng.integers(42, 80))))
        x, y = sorted((a, changed(rng, a, 2)), key=len)
        own = {(len(x), i, x[p : p + s]) for i, (p, s) in enumerate(line_dedup.segments(len(x)))}
        assert own & {(m, i, y[q : q + s]) for m, i, q, s in line_dedup.probes(len(y))}


def brute_lines(rows):
    """(doc_id, text) -> text without repeated lines, the first of each class by (doc_id, text hash, line number)."""
    places = sorted({(i is not None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), k, line, t) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.strip()})
    lines = sorted({p[4] for p in places}, key=len)
    links = Union(len(lines))
    for i, a in enumerate(lines):
        most = max(2, len(a) // 20)
        for j in range(i + 1, len(lines)):
            if len(a) >= 40 and len(lines[j]) - len(a) <= most and edits(a, lines[j]) <= most:
                links.join(i, j)
    root = {line: links.top(i) for i, line in enumerate(lines)}
    first, out = {}, {(i, t): [] for i, t in rows if t is not None}
    for known, i, h, k, line, t in places:
        first.setdefault(root[line], (known, i, h, k))
    for i, t in out:
        h = signed(xxhash.xxh64_intdigest(t.encode(), 42))
        out[i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or first[root[x]] == (i is not None, i or 0, h, k))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("group", [256, 4])
def test_line_dedup(make, group):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words, 10)) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [changed(rng, base[int(rng.integers(0, 12))], int(rng.integers(0, 3))) for _ in range(3)] + ["short", f"a line of its own that stands in document number {i * 977} only"]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (7, "short\nnew one\n" + base[0]), (7, "another\nnew one\nshort"), (None, "another\nof nobody\nshort"), (None, "of nobody\nonly here"), (None, None), (101, "")]
    got = line_dedup.drop_repeated_lines(make(rows), group_lines=group).collect()
    want = brute_lines(rows)
    assert Counter((r._row.doc_id, r._row.text, r.text) for r in got) == Counter((i, t, None if t is None else want[i, t]) for i, t in rows)


def test_line_dedup_loses_no_line_of_a_repeated_id(make):
    rows = [(7, "X\nY"), (7, "Z\nX"), (None, "X\nV"), (None, "W\nU")]
    left = [line for r in line_dedup.drop_repeated_lines(make(rows)).collect() for line in r.text.split("\n")]
    assert sorted(left) == ["U", "V", "W", "X", "Y", "Z"]


def test_line_dedup_parts_large_groups(make, spark, monkeypatch):
    """Lines that share an opening are parted by further keys: few rows a line, and no like pair is lost."""
    rng = np.random.default_rng(14)
    opening = "this opening stands before every line of the table and is long "
    lines = sorted({opening + "".join(rng.choice(list("abcdefghij"), 30)) for _ in range(3000)})
    pairs = [(x, opening + changed(rng, x[len(opening) :], 2)) for x in lines[:300]]
    docs = make([(i, x) for i, x in enumerate([*lines, *(y for _, y in pairs)])])
    rows, kept = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (out := kept(df, name), rows.append(out.count()) if name in ("line-parted", "line-groups") else None)[0])
    edges = line_dedup.like_lines(docs, n_lines=len(lines)).collect()
    assert rows and max(rows) <= 60 * len(lines)
    hashed = {signed(xxhash.xxh64_intdigest(x.encode(), 42)): x for p in [*pairs, *zip(lines, lines)] for x in p}
    assert all(edits(hashed[a], hashed[b]) <= 4 for a, b in edges)
    tops = {x: x for x in hashed.values()}

    def top(x):
        while tops[x] != x:
            x = tops[x]
        return x

    for a, b in edges:
        tops[top(hashed[a])] = top(hashed[b])
    assert all(top(x) == top(y) for x, y in pairs)


def test_line_keys():
    """Keys made from arrays are those of the substrings, and the same in any company."""
    lines = ["".join(np.random.default_rng(i).choice(list("abcdé"), 40 + 7 * i)) for i in range(20)]
    keys, line, row = line_dedup.line_keys(lines)
    for i, x in enumerate(lines):
        alone = line_dedup.line_keys([x])
        assert keys[line == i].tolist() == alone[0].tolist() and row[line == i].tolist() == alone[2].tolist()
    twice = line_dedup.line_keys([lines[12], lines[12][:-1] + "z"])[0].reshape(-1)
    assert len(np.unique(twice)) < len(twice)


def test_short_repeated_lines_go(make):
    rows = [(1, "All rights reserved.\n\nown line\n  \n}"), (2, "All rights reserved.\n\nown lime\n  \n}"), (3, "x\nx\nAll rights reserved.")]
    got = {r._row.doc_id: r.text for r in line_dedup.drop_repeated_lines(make(rows)).collect()}
    assert got == {1: rows[0][1], 2: "\nown lime\n  ", 3: "x"}


def test_edits_grow_with_lines(make):
    rng = np.random.default_rng(12)
    rows, same = [], set()
    for i in range(30):
        line = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(8 + 6 * i))
        words = line.split()
        words[len(words) // 2] = "qrstuv"
        rows += [(i, line), (100 + i, " ".join(words))]
        if edits(line, rows[-1][1]) <= max(2, len(line) // 20):
            same.add(100 + i)
    assert 20 < len(same) < 30
    assert {r._row.doc_id for r in line_dedup.drop_repeated_lines(make(rows)).where("gone IS NOT NULL").collect()} == same


def test_many_edits():
    rng = np.random.default_rng(13)
    for _ in range(500):
        a = "".join(rng.choice(list("ab"), int(rng.integers(11, 25))))
        b = changed(rng, a, int(rng.integers(0, 9)))
        for e in range(1, 9):
            assert line_dedup.within_many(a, b, e) == (edits(a, b) <= e), (a, b, e)
    asked, want = [], []
    for _ in range(300):
        a = "".join(rng.choice(list("abc"), int(rng.integers(20, 70))))
        b = changed(rng, a, int(rng.integers(5, 40))) if rng.integers(0, 4) else "".join(rng.choice(list("abc"), int(rng.integers(20, 70))))
        d = edits(a, b)
        for e in range(max(1, d - 3), d + 4):
            assert line_dedup.within_many(a, b, e) == (d <= e), (a, b, e)
            asked.append((a, b, e))
            want.append(d <= e)
    for _ in range(60):
        a = "".join(rng.choice(list("abcdefgh é漢"), int(rng.integers(150, 400))))
        b = changed(rng, a, int(rng.integers(20, 130)))
        d = edits(a, b)
        for e in {d - 1, d, d + 1, 31, 32, 63, 64, 95, 96}:
            asked.append((a, b, e))
            want.append(d <= e)
    assert line_dedup.all_within(asked).tolist() == want


# odd and empty tables, and the pipeline


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10"])
def test_odd_and_empty_tables(name, odd, empty):
    module = {"op1": mixing, "op2": simhash, "op3": licenses, "op4": sharding, "op5": exact_dedup, "op6": bpe, "op8": language, "op9": media, "op10": line_dedup}[name]
    run = getattr(module, f"{name}_query")
    assert run(odd).count() == len(ODD) and run(empty).count() == 0


def test_toxicity_odd_and_empty(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (7, 0, None), (None, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op7_query(odd, labels).count() == len(ODD) and toxicity.op7_query(empty, labels).count() == 0


def test_pipeline_stages(spark, small):
    """Each stage on what the one before kept, against brute force."""
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, small, SMALL)
    assert kept.columns == small.columns
    judged = {r.doc_id: r._language.rejected for r in language.identify(small).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, no in judged.items() if not no) and kept.count() >= 0.97 * small.count()
    lines = stages["lines"](spark, kept, SMALL)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    got = {r.doc_id: r.text for r in lines.collect()}
    places = {r._row.doc_id: (r.gone, r.near) for r in line_dedup.drop_repeated_lines(kept).collect()}
    want = exact_lines(rows, {i: set(gone or ()) for i, (gone, near) in places.items() if near})
    assert lines.columns == small.columns and got == {i: t for i, t in want.items() if t.strip() or not places[i][0]}
    near = stages["near_duplicates"](spark, lines, SMALL)
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    links = Union(len(rows))
    for a, b in jaccard_pairs([t for _, t in rows]):
        links.join(a, b)
    assert sorted(r.doc_id for r in near.collect()) == sorted({rows[links.top(i)][0] for i in range(len(rows))})
    mixed = stages["mixing"](spark, near, SMALL)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in mixing.plan_mix(near).collect() if r.copies})
    done = stages["tokens"](spark, mixed, SMALL)
    assert done.count() == mixed.count() and done.where("size(ids) <> n_tokens").isEmpty()


def exact_lines(rows, near):
    """Line dedup of equal lines, and of the lines that ``near`` says of documents with near lines."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        kept = []
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                goes = line in seen or k in near.get(i, ())
                seen.add(line)
                if goes:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_pipeline_odd_and_empty(spark, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100


def jaccard_pairs(texts):
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    met = Counter((a, b) for v in inverted.values() for k, b in enumerate(v) for a in v[:k])
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in met.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def test_near_duplicates_by_similarity(spark, make):
    """Near copies at a similarity of just over 0.8 go, those just under it stay."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + 20 * i)]
        copy = list(words)
        for at in range(7, len(words) - 5, 48 + i % 12 if i % 4 else 25):
            copy[at] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy))]
    pairs = jaccard_pairs([t for _, t in rows])
    assert 20 <= len(pairs) < 40
    stay = corpus_pipeline.without_near_duplicates(spark, make(rows), SMALL)
    gone = {rows[b][0] for _, b in pairs}
    assert sorted(r.doc_id for r in stay.collect()) == sorted({i for i, _ in rows} - gone)


def test_near_duplicates_on_repeated_ids(spark, make):
    """(doc_id, text) pairs are judged by themselves, with and without doc_id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (7, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (None, text(4)), (None, text(4)), (None, text(5)), (9, text(5)), (8, None), (8, "")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, make(rows), SMALL).collect()]
    assert sorted((str(i), t) for i, t in got if i != 8) == sorted([("1", text(1)), ("7", text(2)), ("7", text(3)), ("None", text(4)), ("9", text(5))])
    assert sum(i == 8 for i, _ in got) == 1


def test_near_duplicates_cut_large_groups(make, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)] + [(100 + i, f"text {i} of its own kind {i * i}") for i in range(20)]
    monkeypatch.setattr(shingles, "GROUP_SETS", 8)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(make(rows)).collect()}
    assert got == {i: 0 if i < 60 else i for i, _ in rows}


def test_near_duplicates_go_through_trees(monkeypatch):
    """All sets of a shard enter a BK-tree, and only sets within its radius are compared; none of them is lost."""
    rng = np.random.default_rng(11)
    sets = {}
    for i in range(0, 60, 2):
        items = np.unique(rng.integers(0, 2**63, 40 + 5 * i, dtype=np.uint64))
        few = np.r_[items[len(items) // 20 :], rng.integers(0, 2**63, len(items) // 20, dtype=np.uint64)]
        sets |= {i: (simhash.fingerprint_of(items), items), i + 1: (simhash.fingerprint_of(few), np.unique(few))}
    want = [(i + 1, i) for i in range(0, 60, 2)]
    assert all(shingles.similar(sets[a][1], sets[b][1]) for a, b in want)
    entered, asked, add, similar = [], [], simhash.BKTree.add, shingles.similar
    monkeypatch.setattr(simhash.BKTree, "add", lambda tree, value: entered.append(value) or add(tree, value))
    monkeypatch.setattr(shingles, "similar", lambda a, b: asked.append(1) or similar(a, b))
    assert shingles.forest(sets) == want
    assert len(entered) == 60 and len(asked) < 0.4 * 60 * 59 / 2


def test_lines_of_one_tree_are_not_compared_again(monkeypatch):
    """A family of alike lines in many small groups takes about one comparison a line, and no like line is lost."""
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("abcdefgh "), 240))
    lines = {k: base[: 8 * k] + "#" + base[8 * k + 1 :] for k in range(30)} | {100 + k: "".join(rng.choice(list("abcdefgh "), 240)) for k in range(10)}
    names = list(lines)
    groups = {g: [names[int(i)] for i in rng.choice(40, 12, replace=False)] for g in range(40)}
    asked, real = [], line_dedup.all_within
    monkeypatch.setattr(line_dedup, "all_within", lambda pairs: asked.extend(pairs) or real(pairs))
    links = Union(40)
    for a, b in line_dedup.forest([(lines, groups, 0)]):
        links.join(names.index(a), names.index(b))
    assert len({links.top(i) for i in range(30)}) == 1 and len({links.top(i) for i in range(40)}) == 11
    assert len(asked) <= 40


def test_text_hashes_are_taken_once_a_text(make):
    """The hash of a whole text stands under the explode in the plan, so it is not worked out for each line."""
    docs = make([(1, "a\nb"), (2, "c\nb")])
    hashed, kept = [], line_dedup.written
    line_dedup.written = lambda df, name: hashed.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name) if name == "line-places" else kept(df, name)
    try:
        line_dedup.repeated_lines(docs)
    finally:
        line_dedup.written = kept
    above = hashed[0].split("Generate")[0]
    assert "xxhash64(text" not in above


def test_pivots_and_blocks_lose_no_like_line(monkeypatch):
    """Large groups of lines of one family: the classes are those of all pairs, whole or in blocks that meet."""
    monkeypatch.setattr(line_dedup, "PIVOTED", 16)
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 4)))) for _ in range(40)]
    base, lines = list(rng.choice(words, 28)), []
    for _ in range(60):
        line = list(base)
        for _ in range(int(rng.integers(0, 6))):
            line[int(rng.integers(0, len(line)))] = str(rng.choice(words))
        lines.append(" ".join(line))
    lines = dict(enumerate(dict.fromkeys(lines)))
    want = Union(len(lines))
    like = {(i, j) for i in lines for j in range(i) if edits(lines[i], lines[j]) <= line_dedup.allowed(min(len(lines[i]), len(lines[j])))}
    for i, j in like:
        want.join(i, j)
    meets = {(a, b): {i: x for i, x in lines.items() if i % 2 in (a, b)} for a, b in ((0, 0), (1, 1), (0, 1))}
    for bundles in ([(lines, {1: list(lines)}, 0)], [(part, {1: list(part)}, 2 if a != b else 0) for (a, b), part in meets.items()]):
        got = Union(len(lines))
        found = line_dedup.forest(bundles)
        for i, j in found:
            got.join(i, j)
        assert all((max(e), min(e)) in like for e in found)
        assert [got.top(i) for i in lines] == [want.top(i) for i in lines]
    assert 2 < len({want.top(i) for i in lines}) < len(lines) - 10
