"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(texts, path, end_id, special_as_text=False):
    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end_id] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def substrings(rows, width=13):
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)"""
    last = float("inf")
    first = {}
    split = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for key, _, w in split:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            first[s] = min(first.get(s, last), key)
    out = []
    for key, i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key:
                gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """(doc_id, text) -> (doc_id, fingerprint, component_id)"""
    fp = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fp))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    arr = np.array(distinct, np.uint64)
    for i, x in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ x) <= 3):
            root[find(distinct[i])] = find(distinct[i + 1 + int(j)])
    least = defaultdict(list)
    for (i, _), x in zip(rows, fp):
        if i is not None:
            least[find(x)].append(i)
    return [(i, f"{x:016x}", min(least[find(x)], default=None)) for (i, _), x in zip(rows, fp)]
