"""Operators with one right answer, against plain versions."""

import io
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from . import brute
from .fixtures import documents, frame


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.mark.parametrize("shard_bytes", [1 << 28, 1])
def test_token_shards(spark, docs, shard_bytes):
    from concord.llm.shards import shard_report

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = shard_report(frame(spark, docs), path, shard_bytes=shard_bytes).orderBy("start").collect()
    files = len({r["file"] for r in got})
    assert files > 4 if shard_bytes == 1 else files <= 4
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((d[0], len(t), brute.crc(t)) for d, t in zip(docs, brute.tokens([d[1] for d in docs], path, 2)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert shard_report(frame(spark, []), path).collect() == []


def test_shard_lookup():
    from concord.llm.shards import ShardReader, ShardWriter, id_of, key_of

    sink = io.BytesIO()
    writer = ShardWriter(sink)
    keys = sorted([None, -(2**63), -1, 0, 2**63 - 1, *range(10, 60000, 3)], key=lambda x: key_of(x))
    for k in keys:
        writer.add(key_of(k), np.arange((k or 0) % 50 + 1))
        if k == 40:
            writer.add(key_of(k), np.array([9]))
    assert writer.close() == len(sink.getvalue())
    reader = ShardReader(sink)
    assert len(reader.index) > 3
    assert [id_of(k) for k, _ in reader.scan() if id_of(k) != 40] == [k for k in keys if k != 40]
    for k in (None, -1, 10, 13, 59998):
        assert [x.tolist() for x in reader.get(k)] == ([list(range((k or 0) % 50 + 1))] if k in keys else [])
    assert [len(x) for x in reader.get(40)] == [41, 1]
    assert reader.get(11) == [] and sum(reader.may_hold(key_of(k)) for k in range(11, 60000, 3)) < 1000
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(sink.getvalue()[:-1]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_library(name):
    import random

    import pyarrow as pa

    from concord.llm.span_tokens import encoder

    path, r = public_tokenizers.path(name), random.Random(3)
    letters = list(" \n\t ab'sX1.,!\u00e9\u00a0\u3000\u65e5\x1c\u0301\r\u0085\u0130")
    texts = [None, "", *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(500))]
    got = [ids[o[i] : o[i + 1]].tolist() for _, ids, o in encoder(path).encode(pa.array(texts)) for i in range(len(o) - 1)]
    assert got == [t[:-1] for t in brute.tokens(texts, path, 0)]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_and_special_tokens_in_texts(name, special_as_text):
    import pyarrow as pa

    from concord.llm.span_tokens import SpanEncoder

    path = public_tokenizers.path(name)
    texts = ["hello <|endoftext|> world <|endoftext|>", None, "plain text", "<|startoftext|>", "<|endoftext|><|endoftext|>x", "ends in <|endof", "text|> begins so", "<|ENDOFTEXT|>", "", "a<|startoftext|>b <|endoftext|", "plain again"]
    got = [ids[o[i] : o[i + 1]].tolist() for _, ids, o in SpanEncoder(path, special_as_text).encode(pa.array(texts)) for i in range(len(o) - 1)]
    assert got == [t[:-1] for t in brute.tokens(texts, path, 0, special_as_text)]
    if not special_as_text and name.startswith("byte"):
        assert got[0] == [31373, 220, 50256, 995, 220, 50256]


def twins():
    """Two words of 1024 letters that hash alike under any polynomial modulo 2 ** 64."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_compares_bytes(name):
    import pyarrow as pa

    from concord.llm.span_tokens import SpanEncoder
    from concord.llm.wordbytes import hashes

    path, (a, b) = public_tokenizers.path(name), twins()
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    texts = [f"{a} {b} {a} x", f"{b} {a}", b, a, f"{b}\n{b} abcdefgh abcdefg\0 abcdefg", None]
    got = SpanEncoder(path)
    for part in (texts[:1], texts[1:], texts):
        found = [ids[o[i] : o[i + 1]].tolist() for _, ids, o in got.encode(pa.array(part, pa.string())) for i in range(len(o) - 1)]
        assert found == [t[:-1] for t in brute.tokens(part, path, 0)]


def test_same_bytes():
    from concord.llm.span_tokens import same_bytes

    data = np.frombuffer(bytes(range(1, 120)) * 2, np.uint8)
    lengths = np.arange(8, 108)
    at = np.arange(100) % 11
    assert same_bytes(data, at, data, at + 119, lengths).all()
    for place in range(60):
        other = data.copy()
        other[119 + place] ^= 1
        want = (at > place) | (at + lengths <= place)
        assert (same_bytes(data, at, other, at + 119, lengths) == want).all()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(spark, docs, batches):
    from concord.llm.substrings import FingerprintIndex, substring_report

    index = FingerprintIndex(spark, buckets=3, fanout=3)
    got = substring_report(frame(spark, docs), batches=batches, index=index)
    assert rows_of(got) == Counter(brute.substrings([d[:2] for d in docs]))
    assert len(index.runs) < 3
    index.drop()
    if batches == 1:
        assert substring_report(frame(spark, [])).collect() == []


def test_index_finds_hits_of_a_later_batch(spark, docs):
    from concord.llm.substrings import FingerprintIndex, _keyed, fingerprints

    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    index = FingerprintIndex(spark, buckets=2)
    keyed = _keyed(frame(spark, docs))
    index.add(fingerprints(keyed.filter("key < 200")))
    hits = index.add(fingerprints(keyed.filter("key >= 200"))).collect()
    texts = {r["content"]: (r["text"] or "").split() for r in keyed.collect()}
    assert hits and all(len(texts[r["content"]]) >= 13 for r in hits)
    both = {r["content"] for r in hits} & {r["content"] for r in keyed.filter("key < 200").collect()}
    assert both  # the documents of history that a new one meets
    whole = spark.table(index.runs[0]).unionByName(spark.table(index.runs[1])).select("anchor", "content", "windows")
    want = {(r["anchor"], r["content"], tuple(sorted(r["windows"]))) for r in whole.collect()}
    index.compact()
    got = [(r["anchor"], r["content"], tuple(sorted(r["windows"]))) for r in spark.table(index.runs[0]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len({r["tableName"] for r in spark.sql("SHOW TABLES").collect()} - before) == 1
    index.drop()
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before


def test_substrings_compare_words(spark):
    from concord.llm.substrings import substring_report, without_repeats

    a, b = twins()
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}", None, None, None), (2, f"{b} {rest}", None, None, None), (3, f"x {b} {rest}", None, None, None)]
    assert rows_of(substring_report(frame(spark, rows))) == Counter(brute.substrings([r[:2] for r in rows]))
    assert {(r["doc_id"], r["n_removed"], r["kept"]) for r in without_repeats(frame(spark, rows)).collect()} == {(1, 0, rows[0][1]), (2, 0, rows[1][1]), (3, 13, "x")}


def test_a_window_of_very_many_documents(spark):
    from concord.llm.substrings import substring_report

    five = "v w x y z"
    rows = [(i, f"{' '.join(f'{i}a{j}' for j in range(8))} {five} {' '.join(f'{i}b{j}' for j in range(8))} {five if i % 3 else 'q'} {' '.join('same' + str(j) for j in range(20))}", None, None, None) for i in range(3000)]
    assert rows_of(substring_report(frame(spark, rows, False).repartition(8))) == Counter(brute.substrings([r[:2] for r in rows]))


@pytest.mark.parametrize("fanout", [2, 9])
def test_calls_on_one_index_give_the_rows_of_one(spark, docs, fanout):
    from concord.llm.substrings import FingerprintIndex, _keyed, fingerprints, substring_report

    index, got = FingerprintIndex(spark, buckets=2, fanout=fanout), Counter()
    want = Counter(brute.substrings([d[:2] for d in docs]))
    parts = [[d for d in docs if d[0] is not None and d[0] < 200], [d for d in docs if d[0] is not None and 200 <= d[0] < 1006], [d for d in docs if d[0] is None or d[0] >= 1006]]
    for i, part in enumerate(parts):
        got += rows_of(substring_report(frame(spark, part), batches=1 + i % 2, index=index))
    assert got == want
    lost = FingerprintIndex(spark, buckets=2)
    late = rows_of(substring_report(frame(spark, parts[2]), index=lost))  # first come, but the larger ids
    early = rows_of(substring_report(frame(spark, parts[0]), index=lost))
    assert early <= want and not late <= want
    blind = FingerprintIndex(spark, buckets=2)
    blind.add(fingerprints(_keyed(frame(spark, parts[0]))))
    with pytest.raises(ValueError):
        substring_report(frame(spark, parts[1]), index=blind)


def test_simhash(spark, docs):
    from concord.llm.simhash import one_of_each, simhash_report

    got = rows_of(simhash_report(frame(spark, docs)))
    want = brute.components([d[:2] for d in docs])
    assert got == Counter(want)
    kept = one_of_each(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c: 1 for c in {w[2] for w in want}})
    assert simhash_report(frame(spark, [])).collect() == [] and one_of_each(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [2, 16, 2048])
def test_links_in_blocks(spark, block):
    from concord.llm.simhash import components, near_links

    r = np.random.default_rng(5)
    near = [int(x) for x in r.integers(0, 1 << 63, 40, dtype=np.uint64)]
    near += [near[i % 40] ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for i, (a, b, c) in enumerate(r.integers(0, 64, (200, 3)))]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    got = {x["node"]: x["root"] for x in components(near_links(spark.createDataFrame([(x,) for x in values], "fp long"), block=block)).collect()}
    root = {x: x for x in values}
    for _ in range(len(values)):
        new = {x: min(root[y] for y in values if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3) for x in values}
        if new == root:
            break
        root = new
    assert {x: got.get(x, x) for x in values} == root


def test_xxh64_of_spans():
    import xxhash

    from concord.llm.simhash import xxh64

    data = bytes(range(256)) * 2
    starts = np.arange(100)
    ends = starts + np.arange(100) % 70
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def test_media(spark, docs):
    import hashlib
    import zlib

    from concord.llm import media

    got = rows_of(media.media_report(frame(spark, docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
    want = Counter()
    for d in docs:
        raw = (d[1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.to_media(payload)
        want[(d[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.features(payload))] += 1
    assert got == want
    assert media.media_report(frame(spark, [])).collect() == []


def test_media_chunks_are_shared_and_compacted(spark, docs):
    from concord.llm import media
    from concord.llm.common import shared_dir

    folder = shared_dir(spark, "test-packs")
    long = " ".join(str(i * i) for i in range(9000))
    rows = [(1, long, None, None, None), (2, "moved " + long, None, None, None), (3, long, None, None, None)]
    chunks = media.chunk_media(frame(spark, rows, False).repartition(3), folder)
    lists = media.chunk_lists(chunks)
    places = {r["doc_id"]: [tuple(c) for c in r["chunks"]] for r in lists.collect()}
    digests = {k: [c[1] for c in v] for k, v in places.items()}
    assert places[1] == places[3] and len(digests[1]) > 10
    assert len(set(digests[1]) & set(digests[2])) >= len(digests[1]) - 2  # cuts depend on content, not on place
    for found in (lists, media.compact(lists, folder)):
        texts = {r["doc_id"]: media.from_media(bytes(r["media"])).rstrip(b"\0").decode() for r in media.read_media(found, folder).collect()}
        assert texts == {r[0]: r[1] for r in rows}


def test_packing(spark, docs):
    from concord.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    got = pack(frame(spark, docs), path).collect()
    want, total = Counter(), 0
    for d, ids in zip(docs, brute.tokens([d[1] for d in docs], path, 0)):
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(d[0], p, at, len(part), brute.crc(part))] += 1
        total += len(ids)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert pack(frame(spark, []), path).collect() == []


def test_genetic_algorithm_beats_its_seed():
    from concord.llm.packing import best_fit, evolve, lower_bound

    sizes = [3, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 2, 2, 2, 7, 7, 1, 3, 4, 4] * 6
    bins, fills = [], []
    best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, fills, 12)
    found = evolve(sizes, [], [1, 2], 12)[0]
    assert sorted(i for x in found for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= 12 for x in found)
    assert lower_bound(sizes, 12) <= len(found) <= len(bins)
    assert found == evolve(sizes, [], [1, 2], 12)[0]


def test_crossover_improves_packings(monkeypatch):
    """Over some instances of few, large items, the evolved packings need fewer bins than the best of the first generation."""
    from concord.llm import packing

    def used():
        r, total = np.random.default_rng(7), 0
        for _ in range(12):
            sizes = r.integers(150, 500, 120).tolist()
            total += len(packing.evolve(sizes, [], [3], 1000)[0])
        return total

    monkeypatch.setattr(packing, "GENERATIONS", 60)
    evolved = used()
    monkeypatch.setattr(packing, "cross", lambda a, b, sizes, rng, capacity: [list(x) for x in a])
    assert evolved < used()
