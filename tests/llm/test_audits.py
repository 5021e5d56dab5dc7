"""Source divergence, the media store and structure repair against brute-force versions, with odd rows."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evoframe.llm import divergence, media_chunks, queries, structure_repair

from evoframe.llm.oracles import ORACLE

DATA = "/root/testdata/sf0.001"


def plain_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = term.findall("".join(c.lower() if c.isascii() else c for c in text))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (divergence.UNIT * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        of, all_ = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            word = [(all_[t] - of[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and of[s][t] > all_[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(word)[:top])):
                out += [(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(found)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    r = random.Random(4)
    words = ["a", "B", "b", "é", "É", "straße", "中文", "x1y", "don't", "K", "z"]
    rows = [(" ".join(r.choices(words, weights=range(1, 12), k=r.randint(0, 9))), r.choice(["en", "en", "fr", "", None]), r.choice(["s1", "s2", "s3", "S3", None, "é"]), "x", 3) for _ in range(300)]
    rows += [(None, "en", "empty", "y", 1), ("", "xx", None, "y", 1), ("only here", "xx", "q", "y", 1), ("a " * 30_000, "fr", "s1", "long", 1)] + [rows[0]] * 5
    df = spark.createDataFrame(rows, "text string, lang string, source string, item string, rank int").repartition(3)
    want = plain_divergence([x[:3] for x in rows], 5, 3)
    assert {x[2] for x in want} == {"pair", "term"} and any(x[4] == 0 for x in want)
    read = lambda found: sorted(tuple(x) for x in found.select("lang", "source", "part", "item", "value", "rank").collect())
    assert read(divergence.divergence(df, least=5, top=3)) == want
    monkeypatch.setattr(divergence, "BLOCK", 2)  # several blocks of sources and buckets of terms
    monkeypatch.setattr(divergence, "TERMS", 3)
    assert read(divergence.divergence(df, least=5, top=3)) == want
    assert divergence.divergence(df.limit(0)).count() == 0


def test_share_beyond_64_bits(spark):
    got = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(3 * 10**13), F.lit(7)).alias("p")).first().p
    assert got == 1 + (divergence.UNIT * (10**13 + 5)) // (3 * 10**13 + 35)


def plain_cuts(data, least, most, bits):
    out, start = [0], 0
    while start < len(data):
        end = start
        while True:
            end += 1
            h = 0
            for b in data[max(0, end - 64) : end]:
                h = (h << 1) + int(media_chunks.BYTE[b]) & (1 << 64) - 1
            if end == len(data) or end - start == most or end - start >= least and h >> (64 - bits) == 0:
                break
        out.append(end)
        start = end
    return out


def test_cuts():
    r = np.random.default_rng(2)
    for data in (r.integers(0, 4, 5000).astype(np.uint8), np.zeros(1000, np.uint8), r.integers(0, 256, 64).astype(np.uint8), np.zeros(0, np.uint8)):
        assert media_chunks.cuts(media_chunks.marks(data, 5), 0, len(data), 70, 300) == plain_cuts(data.tolist(), 70, 300, 5)
    data = r.integers(0, 256, media_chunks.SLICE_BYTES * 2 + 77).astype(np.uint8)  # windows of a long payload
    assert np.array_equal(media_chunks.marks(data, 9), np.flatnonzero(media_chunks.gear(data) >> np.uint64(55) == 0))
    moved = media_chunks.cuts(media_chunks.marks(np.concatenate([data[:9000], data[:7], data[9000:]])), 0, len(data) + 7)
    same = set(media_chunks.cuts(media_chunks.marks(data), 0, len(data))) & {c - 7 for c in moved}
    assert len(same) > 0.9 * len(moved)  # an insertion moves the cuts near it only


def test_media_store(spark, tmp_path):
    r = random.Random(1)
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    base = noise(20_000)
    values = [None, b"", b"x", base, base, base[:9000] + b"!" + base[9000:], noise(3000), noise(3000) * 3, b"\0" * 9000, noise(200_000), *([b"copy" * 100] * 50)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in enumerate(values)], "media long, payload binary, size string, digest string").repartition(4)
    root = f"file://{tmp_path}/store"
    media_chunks.write_media(df, root, least=64, most=2048, bits=7)
    found = {x.media: bytes(x.wav) for x in media_chunks.read_media(spark, root).collect()}
    assert found == {hashlib.sha256(v or b"").hexdigest(): media_chunks.wav(v or b"") for v in values}
    assert all(bytes(media_chunks.samples(w)) == v for v, w in ((v or b"", media_chunks.wav(v or b"")) for v in values))
    chunks = spark.read.parquet(f"{root}/chunks").collect()
    assert len({bytes(x.digest) for x in chunks}) == len(chunks)
    kept = sum(len(x.data) for x in chunks) + sum(len(y) for x in spark.read.parquet(f"{root}/packs").collect() for y in x.data)
    assert kept < len(base) * 1.3 + 3000 * 2.5 + 2048 * 2 + 200_000 + 500  # a shared chunk is there once
    assert media_chunks.read_media(spark, f"file://{tmp_path}/store").count() == len(found)
    media_chunks.write_media(df.limit(0), f"file://{tmp_path}/empty")
    assert media_chunks.read_media(spark, f"file://{tmp_path}/empty").count() == 0


def test_media_store_that_is_damaged(spark, tmp_path):
    df = spark.createDataFrame([(b"abc" * 50,), (b"abc" * 50,)], "payload binary")
    for how in ("gone", "other"):
        root = f"file://{tmp_path}/{how}"
        media_chunks.write_media(df, root)
        chunks = spark.read.parquet(f"{root}/chunks").collect()
        rows = [] if how == "gone" else [(bytes(x.digest), b"zzz") for x in chunks]
        spark.createDataFrame(rows, "digest binary, data binary").write.mode("overwrite").parquet(f"{root}/chunks")
        with pytest.raises(Exception, match="not there|not what was stored"):
            media_chunks.read_media(spark, root).collect()


def test_media_features():
    x = bytes([0, 255, 128, 127, 5])
    found = media_chunks.features(media_chunks.wav(x))
    assert found == (5, hashlib.sha256(x).hexdigest(), zlib.crc32(x), 50, hashlib.sha256(media_chunks.wav(x)).hexdigest(), f"sum={sum(x)};squares={sum(b * b for b in x)};crossings=2")
    with pytest.raises(ValueError):
        media_chunks.samples(b"RIFFxxxxWAVE")


def plain_repair(rows):
    """Best first by (cost, letters); rows are (turn, role, text) in order."""
    blank = duplicate = truncated = 0
    seen, codes = set(), []
    for _, role, text in rows:
        said, fault = re.findall(r"[^\x20\x09-\x0D]", text), ""
        if not said:
            fault, blank = "b", blank + 1
        elif (role, text) in seen:
            fault, duplicate = "d", duplicate + 1
        elif said[-1] not in ".!?":
            fault, truncated = "t", truncated + 1
        seen.add((role, text))
        codes.append((role[:1], fault))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, initials, made = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return gaps, blank, duplicate, truncated, illegal, cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest()
        if (i, initials[-1:]) in done:
            continue
        done.add((i, initials[-1:]))
        ways = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            (_, role, text), (initial, fault) = rows[i], codes[i]
            ways.append((4, "D", i + 1, "", ()))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if initial in ("s", "u", "a"):
                    ways.append((more, "K", i + 1, initial, (f"{role}:{text}",)))
                ways += [(3 + more, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, letter, j, new, line in ways:
            if re.fullmatch(r"s?(ua)*u?", initials + new):
                heapq.heappush(heap, (cost + c, edits + letter, j, initials + new, made + line))


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_structure_repair(spark):
    r = random.Random(3)
    texts = ["a.", "b", "", "  ", "c!", "d", "?", "e f.", "\x0b\n", None, "é", ".  "]
    rows = []
    for c in [*range(120), None]:
        t = 0
        for _ in range(r.choice([1, 2, 3, 5, 8, 13])):
            t += r.choice([0, 1, 1, 1, 2])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), r.choice(texts), "x", "y"))
    rows += [(900, t, r.choice(["user", "assistant"]), f"{r.choice(['x.', 'y', 'z!'])}{t}{r.choice(['.', ''])}", "x", "y") for t in range(300)]
    rows += [(901, 5, "user", "same.", "x", "y")] * 200 + [(901, 6, "assistant", "same.", "x", "y"), (902, 1, "user", "long " * 50_000 + ".", "x", "y")]
    by = defaultdict(list)
    for c, turn, role, text, _, _ in rows:
        by[c].append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: plain_repair(in_order(v)) for c, v in by.items()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, edits string, place string").repartition(5)
    for size in (structure_repair.SEGMENT, 60):  # whole conversations, and segments of a few rows
        made = structure_repair.repair_conversations(df, segment=size)
        assert {x.conv_id: tuple(x[k] for k in REPORT) for x in structure_repair.report(made).collect()} == want
        if size == 60:
            assert made.where("parts > 1").count() > 20
    assert structure_repair.repair_conversations(df.limit(0)).count() == 0


def test_structure_repair_query(spark, tmp_path):
    rows = pq.read_table(f"{DATA}/conversations.parquet").to_pylist()
    odd = [(None, 1, "user", "Hi."), (70, None, None, None), (70, 2, "assistant", "Yes."), (71, 0, "user", "?"), (72, 9, "user", "a?"), (72, 9, "user", "a?")]
    odd += [(c, 1, "user", "Dropped.") for c in range(1000, 1060)]
    rows = [tuple(x[k] for k in ("conv_id", "turn", "role", "text")) for x in rows] + odd
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        by[c] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    got = {x.conv_id: tuple(x[k] for k in REPORT) for x in queries.op13_structure_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain_repair(in_order(v)) for c, v in by.items()}
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())


def test_edits_of_equal_cost():
    """The least letters win, and a shorter list of edits before a longer one that begins with it."""
    for rows in ([(0, "assistant", "a.")], [(0, "user", "a.")], [(0, "user", "a."), (1, "user", "b.")], [(0, "system", "s.")], [(0, "user", "a"), (1, "assistant", "b")], [(0, "tool", "t."), (1, "tool", "u.")]):
        faults = [structure_repair.FINE if t.endswith(".") else structure_repair.TRUNCATED for _, _, t in rows]
        codes = [("sua".find(r[0]) if r[0] in "sua" else 3) + 4 * f for (_, r, _), f in zip(rows, faults)]
        costs = [structure_repair.END]
        for q in reversed(codes):
            costs.append(structure_repair.backward(costs[-1], q)[0])
        f, at, letters = structure_repair.FIRST, frozenset([structure_repair.START]), ""
        for q, b in zip(codes, costs[::-1][1:]):
            more, _, at = structure_repair.walk(f, q, b, at)
            f, letters = structure_repair.forward(f, q)[0], letters + more
        while structure_repair.END[min(at)]:
            at, letters = frozenset(structure_repair.NEXT[s] for s in at), letters + "I"
        assert letters == plain_repair(rows)[6]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_media_chunks"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{DATA}/documents.parquet'")
    ours, theirs = queries.QUERIES[name](spark, DATA), c.sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(k) for k in columns]
    assert sorted(tuple(str(x[k]) for k in columns) for x in ours.collect()) == sorted(tuple(str(x[i]) for i in at) for x in theirs.fetchall())


def test_media_query_odd_texts(spark, tmp_path):
    texts = [None, "", "a" * 63, "a" * 64, "a" * 65, "é" * 32, "\0", "", "a" * 64, "x" * 300_000]
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op12_media_chunks(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw_padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-64:]))
