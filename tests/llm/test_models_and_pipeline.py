"""Trained operators on held-out rows and against plain steps, secrets against plain versions, and the pipeline's stages."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from . import brute
from .fixtures import SCHEMA, documents, frame

DATA = "/root/testdata/sf0.01"


def test_language(spark):
    from concord.llm.language import language_report

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_report(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_report(frame(spark, documents())).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (2000, 2001, 2002))
    assert language_report(frame(spark, [])).collect() == []


def test_quality(spark):
    from concord.llm.quality import quality_report

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality_report(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = quality_report(frame(spark, documents()), none).collect()
    assert len(odd) == len(documents()) and {r["score"] for r in odd} == {0.5}


def test_leader_step_is_the_plain_one():
    from concord.llm.language import ALPHA, BETA, L1, L2, leader_step

    r = np.random.default_rng(4)
    z, n, x, bias = r.normal(size=(7, 3)) * 0.01, r.random((7, 3)), r.random(7), r.normal(size=3)
    w = [[0.0 if abs(z[i, k]) <= L1 else -(z[i, k] - (L1 if z[i, k] > 0 else -L1)) / ((BETA + n[i, k] ** 0.5) / ALPHA + L2) for k in range(3)] for i in range(7)]
    s = [sum(x[i] * w[i][k] for i in range(7)) + bias[k] for k in range(3)]
    p = [np.exp(v) / sum(np.exp(u) for u in s) for v in s]
    new_z, new_n, new_bias = leader_step(z, n, x, bias, 1)
    for i in range(7):
        for k in range(3):
            g = (p[k] - (k == 1)) * x[i]
            sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / ALPHA
            assert np.isclose(new_z[i, k], z[i, k] + g - sigma * w[i][k]) and np.isclose(new_n[i, k], n[i, k] + g * g)
    assert np.allclose(new_bias, bias - 0.01 * (np.array(p) - [0, 1, 0]))


def test_trees_walk_like_plain_trees():
    from concord.llm.quality import train

    r = np.random.default_rng(6)
    x = r.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    model = train(x[:400], y[:400], trees=12)

    def plain(row):
        total = model.base
        for node in model.roots:
            while model.threshold[node] != np.inf:  # a leaf has no threshold
                node = model.child[node] + (1 if row[model.feature[node]] > model.threshold[node] else 0)
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    got = model.score(x)
    assert np.allclose(got, [plain(row) for row in x])
    assert np.mean((got[400:] >= 0.5) == (y[400:] == 1)) > 0.9


def plain_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    for kind, rule, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(kind, *m.span()) for m in re.finditer(rule, text) if m.end() - m.start() >= least]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark):
    from concord.llm.secret_scan import redact_secrets, secret_report

    texts = [None, "", "PassWord = 'hunter22' token:x", "é AKIA" + "A1" * 9 + " api_key=" + "0a" * 14, "secret=token=abcdefg", "x" + "ab12" * 7 + "g", "passwd: \"abc\" \U0001f600 apikey=ABCDEFGH"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [r for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(300).collect()]
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    want = Counter()
    for r in rows:
        found = plain_secrets(r[1])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[(r[0], *(sum(s[0] == k for s in found) for k in ("assign", "access", "hex")), hashlib.sha256(base.encode()).hexdigest())] += 1
    got = secret_report(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert Counter(map(tuple, got)) == want
    clean = redact_secrets(df)
    assert clean.columns == df.columns and all(not plain_secrets(r["text"]) for r in clean.limit(7).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = stages["near_duplicates"](spark, docs, DATA)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c: 1 for c in {w[2] for w in brute.components([d[:2] for d in documents()])}})
    clean = stages["secrets"](spark, docs, DATA)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    mixed = stages["mixing"](spark, docs, DATA)
    assert mixed.schema == docs.schema
    from concord.llm.mixing import mix_report

    taken = sum(r["taken"] for r in mix_report(docs).collect())
    assert sum(len(brute.WORD.findall(r["text"] or "")) for r in mixed.collect()) == taken
    good = stages["quality"](spark, docs, DATA)
    assert good.schema == docs.schema
    empty = spark.createDataFrame([], SCHEMA)
    for stage in stages.values():
        assert stage(spark, empty, DATA).collect() == []


def test_mix_tells_documents_of_one_id_apart(spark):
    from concord.llm.mixing import mix, mixed_documents

    rows = [(None, " ".join(f"{s}{i}x{j}" for j in range(20)), "en", s, i) for s, n in (("a", 9), ("b", 40), ("c", 70)) for i in range(n)]
    rows += [(5, " ".join(f"same{j}" for j in range(20)), str(i), s, i) for s in ("b", "c") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want, got, cut = Counter(), Counter(), Counter()
    for r in mix(docs).collect():
        want[r["source"]] += r["taken"]
    whole = {r[1] for r in rows}
    for r in mixed_documents(docs).collect():
        got[r["source"]] += len(r["text"].split())
        cut[r["source"]] += r["text"] not in whole
    assert got == want and max(cut.values()) <= 1
    copies = spark.createDataFrame([*((7, "p q r s t u v", str(i), "c", i) for i in range(31)), (1, "one two", "en", "a", 1), (2, "x " * 400, "en", "b", 1)], SCHEMA)
    takes = Counter(r["taken"] for r in mix(copies).filter("doc_id = 7").collect())
    by_row = Counter()
    for r in mixed_documents(copies).filter("doc_id = 7").collect():
        by_row[r["lang"]] += len(r["text"].split())
    assert len(takes) > 1 and Counter(by_row[str(i)] for i in range(31)) == takes
