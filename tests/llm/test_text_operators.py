"""Operators on texts against brute force on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagwatch.llm import decontamination, jaccard_join, license_scan, packing, scratch, token_shards
from tagwatch.llm.tokens import TextEncoder
from tagwatch.llm.wavelet_matrix import StoredBits, WaveletMatrix

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans int, n int, sig string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows(extra=()):
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "a null id"), (5, "x " * 40_000), *extra]
    return [(i, t, None, None, None, 1, 2, "s") for i, t in rows]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def contaminated_by_hand(docs, items):
    windows = {}
    for name, text in items:
        words = WORD.findall(lower(text))
        for k in range(max(1, len(words) - 12)) if words else ():
            windows.setdefault(tuple(words[k : k + 13]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        hit, met = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    met |= own
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def test_decontamination_equals_brute_force(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "Short item"), (901, None), (902, "")], "item_id long, text string")
    items = benchmark.unionByName(extra)
    planted = spark.createDataFrame([(10**6, "so SHORT-item, short item!"), (10**6 + 1, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(planted)
    want = contaminated_by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    for block in (decontamination.BLOCK_BYTES, 4000):  # in one pass, and in several
        decontamination.BLOCK_BYTES, kept = block, decontamination.BLOCK_BYTES
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(docs, items).collect()}
        decontamination.BLOCK_BYTES = kept
        assert got == want
    assert any(w[4] for w in want.values())


def test_decontamination_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.report(docs, empty).collect()} == {0}
    one = spark.createDataFrame([(None, "word"), (None, None)], "item_id long, text string")
    rows = decontamination.report(docs, one).where("contaminated").collect()
    assert [r.doc_id for r in rows] == [3, 3]
    assert decontamination.clean(docs, one).columns == docs.columns
    assert decontamination.report(docs.limit(0), one).count() == 0


def links_by_hand(docs):
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc_id] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(changes + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"w{rng.randrange(10**6)}"] * rng.randrange(3)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("docs_at_once", "shingles_at_once"), [(jaccard_join.DOCS, jaccard_join.SHINGLES), (8, 500)])
def test_jaccard_join_equals_brute_force(spark, docs_at_once, shingles_at_once, monkeypatch):
    rng = random.Random(7)
    texts = []
    for size in (6, 7, 9, 12, 20, 40, 80, 200):
        for _ in range(3):
            base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(size))
            texts += family(rng, base, 12, max(1, size // 25))
    core = " ".join(f"c{k}" for k in range(60))
    texts += [f"{core} " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))) for _ in range(40)]
    texts += ["one", "one", "two words", None, "", "A b C d", "a B c D"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "DOCS", docs_at_once)
    monkeypatch.setattr(jaccard_join, "SHINGLES", shingles_at_once)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == links_by_hand(docs)


def test_a_family_that_common_shingles_hold_together_is_parted(spark, monkeypatch):
    rng, rows, compared = np.random.default_rng(7), [], []
    for k in range(40):
        own = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 30))
        rows += [(2 * k, f"one line that all texts hold {own}"), (2 * k + 1, f"one line that all texts hold {own} more")]
    compare = jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "DOCS", 8)
    monkeypatch.setattr(jaccard_join, "_signatures", lambda sets, plans: sets.select(F.lit(1).cast("long").alias("sig"), "doc"))  # one family of all
    monkeypatch.setattr(jaccard_join, "_compared", lambda groups: compared.append(groups.count()) or compare(groups))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(80)} and sum(compared) <= len(rows)  # each set is sent to one group


def test_jaccard_join_of_odd_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(odd_rows(), DOCS)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (5, 1, 5)], key=repr)
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_join_of_repeated_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, a), (4, f"{b} more"), (7, a.upper()), (9, "none of these words is anywhere else")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 36, 3), (4, 37, 3), (5, 36, 3), (5, 36, 3), (7, 36, 3), (9, 3, 9)]


def test_every_plan_is_sound():
    """Whatever plan a band takes, sets within the bound share a signature if the plan fits the smaller."""
    assert all(jaccard_join.allowed(n) == n // 3 for n in range(1, 1000))
    assert all(4 * (b - 1) // 3 < c for b, c in zip(jaccard_join.STARTS[1:], jaccard_join.STARTS[2:], strict=False))


TEXTS = [
    "  a  b\n\n c\t d's   ", "", "it's DON'T'LL  x_y 12 ab12 Ünï ﬁ İ x² ½", "a   b \x1c c", "<|endoftext|> hi", "'der 's 'S don't", "é café ß ẞ", "中文 ١٢ ΑΣ  ", "_a__b -_- \x00 \x7f",
    " ", " \n ", "a\n\nb  c \t d\n", " lead", "trail ", "x\n y\n  z", "1234 a1b2  33", "a\xa0 b \xa0c", "ａ １", "word " * 200_000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(documents, name):
    texts = TEXTS + [r.text for r in documents.select("text").collect()]
    encoder = TextEncoder(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts).tolist()
        for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards_round_trip(spark, documents):
    path = scratch.new_path(spark, "shards")
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None), (10**9, "")], "doc_id long, text string"))
    token_shards.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=2, shards=5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.read(spark, path).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, every = 0, []
    for doc_id, text in sorted((tuple(r) for r in docs.collect())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got.pop(doc_id) == (at, len(ids), crc(ids))
        at += len(ids)
        every += ids
    assert not got
    token = every[100]
    assert sum(r.n for r in token_shards.occurrences(spark, path, token).collect()) == every.count(token)
    row = spark.read.schema(token_shards.FILE).parquet(path).orderBy("shard", "segment").first().asDict()
    segment = token_shards.Segment(row)
    assert segment.access(np.arange(50)).tolist() == every[:50]
    assert segment.locate(token).tolist() == [k for k in range(row["n_tokens"]) if every[k] == token]


def test_a_wavelet_matrix_opens_only_what_it_needs(monkeypatch):
    monkeypatch.setattr(StoredBits, "SHIFT", 7)
    monkeypatch.setattr(StoredBits, "BLOCK", 1 << 7)
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (63, 5), (64, 9), (128, 2), (5000, 300), (5000, 70_000)):
        values = rng.integers(0, top, n).astype(np.uint32)
        width = max(1, (top - 1).bit_length())
        plain = WaveletMatrix.build(values, width)
        stored = WaveletMatrix.opened(*plain.stored(bytes), n, bytes)
        at = rng.integers(0, n, 5)
        assert stored.access(at)[0].tolist() == values[at].tolist()
        assert all(len(x.opened) <= 10 for x in stored.levels) and (n < 5000 or len(stored.levels[0].blocks) > 30)
        assert stored.all().tolist() == values.tolist()
        for v in values[:3].tolist():
            assert stored.rank(np.array([v]), np.array([n]))[0] == (values == v).sum()
            assert stored.locate(v).tolist() == np.flatnonzero(values == v).tolist() == plain.locate(v).tolist()


def test_token_shards_of_odd_rows(spark):
    path = scratch.new_path(spark, "shards")
    token_shards.write(spark.createDataFrame(odd_rows(), DOCS), path, public_tokenizers.path("word_bpe_49k.json"), shards=2)
    rows = token_shards.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 5] and rows[0].start == 0
    path = scratch.new_path(spark, "shards")
    token_shards.write(spark.createDataFrame([], DOCS), path, public_tokenizers.path("word_bpe_49k.json"), shards=2)
    assert token_shards.read(spark, path).count() == 0


def test_packing_loses_nothing(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, text in (tuple(r) for r in docs.collect()):
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    padding = sum({p.sequence_id: p.padded for p in pieces}.values()) / sum(p.length for p in pieces) - 1
    assert padding < 0.05
    assert packing.pack(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(spark.createDataFrame(odd_rows(), DOCS), public_tokenizers.path("byte_bpe_50k.json")).where("doc_id = 3").count() == 2


def test_packing_is_the_same_however_it_is_partitioned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    results = []
    for n in (1, 64, 211):
        got = packing.pack(docs.repartition(n), public_tokenizers.path("byte_bpe_50k.json")).collect()
        padding = sum({p.sequence_id: p.padded for p in got}.values()) / sum(p.length for p in got) - 1
        assert padding <= 0.01
        results.append(sorted(map(tuple, got)))
    assert results[0] == results[1] == results[2]


def test_packing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 50)
    docs = spark.createDataFrame([(k % 3, "one text " * 30) for k in range(900)] + [(k, f"{k} other") for k in range(100)], "doc_id long, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == 1000 and len({(p.sequence_id, p.offset) for p in got}) == 1000
    assert sum({p.sequence_id: p.padded for p in got}.values()) < 1.2 * sum(p.length for p in got) + 20 * 2048


def test_best_fit_is_best_fit():
    rng = random.Random(3)
    lengths = np.array([rng.randrange(1, 65) for _ in range(500)])
    places, offsets, n = packing.best_fit(lengths, 64)
    rooms = []
    for need in sorted(lengths.tolist(), reverse=True):
        able = [r for r in rooms if r >= need]
        rooms.append((min(able) if able else 64) - need)
        if able:
            rooms.remove(min(able))
    assert n == len(rooms)
    assert max(np.bincount(places, lengths)) <= 64 and (offsets >= 0).all()


def aligned_by_hand(words, template):
    """Matched words of the best local alignment over the whole text."""
    best, row = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        new = [(0, 0)]
        for j, w in enumerate(words):
            hit = (row[j][0] + 1, row[j][1] + 1) if w == t else (row[j][0] - 1, row[j][1])
            new.append(max(hit, (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]), (0, 0)))
            best = max(best, new[-1])
        row = new
    return best[1]


def test_license_scan_equals_full_alignment(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        words = text.split()
        noisy = [w for w in words if len(words) < 20 or rng.random() > 0.04]
        body = " ".join([f"x{rng.randrange(999)}" for _ in range(30)] + noisy + [f"y{rng.randrange(999)}" for _ in range(30)])
        rows.append((k, body, None, None, None, 1, 2, "s"))
    rows.append((99, "nothing of the kind under the sun", None, None, None, 1, 2, "s"))
    for k, body, *_ in rows:
        for name, text in license_scan.TEMPLATES.items():
            template = WORD.findall(lower(text))
            if aligned_by_hand(WORD.findall(lower(body)), template) >= license_scan.COVERAGE * len(template):
                want.add((k, name))
    docs = spark.createDataFrame(rows + odd_rows(), DOCS)
    got = license_scan.scan(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(want) >= len(license_scan.TEMPLATES)
    assert all(r.start < r.end and 0 < r.coverage <= 1 for r in got)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_spans(spark):
    """A template word for word, between other words: its very span, all of it."""
    rows = [(k, " ".join([f"x{j}" for j in range(30)] + [text] + [f"y{j}" for j in range(30)])) for k, text in enumerate(license_scan.TEMPLATES.values())]
    got = {(r.doc_id, r.license): (r.start, r.end, r.coverage) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        assert got[k, name] == (30, 30 + len(WORD.findall(lower(text))), 1.0)
