"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def repeats(rows, n):
    """``(doc_id, n_words, n_removed, kept words)``: without the words of windows that start anywhere else."""
    split = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[i : i + n]) for _, w in split for i in range(len(w) - n + 1))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def repeats_digest(rows, n):
    return [(d, k, g, hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, k, g, w in repeats(rows, n)]


def near_duplicates(rows, percent=85, shingle=5):
    """``(doc_id, n_shingles, component_id, kept)`` by comparing all pairs that share a shingle."""
    sets = []
    for d, t in rows:
        w = words(t, lower=True)
        sets.append((d, {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, by_id, least = defaultdict(list), {}, {}
    for i, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
        if d is not None and s:
            if d in by_id:
                parent[find(i)] = find(by_id[d])
            by_id[d] = i
    for i, (d, s) in enumerate(sets):
        if d is not None and s:
            least[find(i)] = min(d, least.get(find(i), d))
    roots = [least.get(find(i)) if s else d for i, (d, s) in enumerate(sets)]
    return [(d, len(s), r, d == r) for (d, s), r in zip(sets, roots, strict=True)]


def base_scores(rows, held):
    """``(doc_id, n_tokens, n_known, train tokens, base score)``; ``held(doc_id)`` tells rows that teach nothing."""
    tokens = [(d, [*words(t, lower=True), None]) for d, t in rows]
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens]


def packed(texts, tokenizer, end, window):
    """Pieces of ``(doc_id, text)`` in the given order."""
    out, at = [], 0
    for d, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        start = 0
        while start < len(ids):
            sequence, offset = divmod(at + start, window)
            part = ids[start : start + window - offset]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            out.append((d, start, len(part), crc, len(ids), sequence, offset))
            start += len(part)
        at += len(ids)
    return out


def check_pieces(pieces, rows, path, window=4096):
    """Every id in exactly one piece, windows full and gapless but for the last one."""
    t = Tokenizer.from_file(path)
    ordered = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    at, order = 0, []
    for r in ordered:
        assert r.sequence_id * window + r.offset == at
        at += r.length
        if r.start == 0:
            order.append(r.doc_id)
    texts = {d: x for d, x in rows}
    want = packed([(d, texts[d]) for d in order], t, 2, window)
    assert [tuple(r)[:7] for r in ordered] == want
    assert sorted(order, key=repr) == sorted((d for d, _ in rows), key=repr)
