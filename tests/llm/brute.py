"""Plain Python versions of the operators, quadratic or worse, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_words(docs: list[tuple], window: int = 20) -> dict:
    """{id: (n_words, n_removed, sha)} for distinct documents, null ids first."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = [w.encode() for w in WORD.findall(text or "")]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            path = tuple(words[i : i + window])
            if path in seen:
                gone[i : i + window] = [True] * window
            seen.add(path)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[key] = (len(words), sum(gone), sha(kept))
    return out


def repeated_bytes(docs: list[tuple], window: int = 400) -> dict:
    counts: Counter = Counter()
    bodies = {key: (text or "").encode() for key, text in docs}
    for body in bodies.values():
        counts.update(body[i : i + window] for i in range(len(body) - window + 1))
    out = {}
    for key, body in bodies.items():
        gone = bytearray(len(body))
        for i in range(len(body) - window + 1):
            if counts[body[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[key] = (len(body), sum(gone), spans, sha(kept))
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict) -> dict:
    """{id: (hex, smallest id reachable)} over links of three bits or fewer."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1 :] ^ values[n]) <= 3):
            a, b = root(i), root(ids[n + 1 + m])
            parent[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def text_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated: set[int] = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(repeated)


def shared_lines(docs: list[tuple], min_docs: int = 3) -> dict:
    """{(id, text): kept lines}; a null id is the smallest."""

    def key_of(line):
        key = ascii_lower(line.strip(" \t\n\r\x0b\x0c"))
        return key if len(key) >= 20 else None

    rank = {d[0]: (d[0] is not None, d[0] or 0) for d in docs}
    holders: dict = {}
    for key, text in docs:
        for line in (text or "").split("\n"):
            if key_of(line):
                holders.setdefault(key_of(line), set()).add(key)
    out = {}
    for key, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            own = holders.get(key_of(line), set())
            if len(own) < min_docs or rank[key] == max(rank[o] for o in own):
                kept.append(line)
        out[key, text] = kept
    return out


def leaks(docs: list[tuple], items: list[tuple]) -> set:
    """{(id, item)} with a window of the item's size at weighted similarity 0.8 or more."""

    def shingles(text):
        words = WORD.findall((text or "").lower())
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    out = set()
    for key, text in docs:
        own = shingles(text)
        for item, body in items:
            want = Counter(shingles(body))
            width = min(want.total(), len(own))
            for at in range(len(own) - width + 1 if width else 0):
                have = Counter(own[at : at + width])
                both = (have & want).total()
                if both >= 0.8 * (have.total() + want.total() - both):
                    out.add((key, item))
    return out


def netstring(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def hashed(*nodes: str) -> str:
    return sha("".join(nodes).encode())


def tree(nodes: list[str]) -> tuple[str, list[list[tuple]]]:
    """The root over runs of three, and for each node what stands beside its path."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i in range(len(nodes)):
            first = at[i] // 3 * 3
            steps[i].append((level[first : at[i]], level[at[i] + 1 : first + 3]))
            at[i] //= 3
        level = [hashed(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], steps


def manifest(docs: list[tuple]) -> list[tuple]:
    """Rows of the Merkle manifest from (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return hashed(*map(netstring, row))

    by: dict = {}
    for row in docs:
        by.setdefault(row[1], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        rows = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (rows, *tree([leaf(r) for r in rows]))
    root, above = tree([trees[source][1] for source in order])
    out = []
    for i, source in enumerate(order):
        rows, subroot, steps = trees[source]
        for row, own in zip(rows, steps):
            path, text = own + above[i], row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*row[:4], text))
            for left, right in path:
                node = hashed(*left, node, *right)
            proof = hashed(*[x for left, right in path for x in (*left, *right)])
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return out


def collocations(docs: list[tuple], least: int, first: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    found: dict[str, Counter] = {}
    words: Counter = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = found.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in found.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {
            q[i : i + k]
            for q, b in chosen.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
            if 100 * b >= 80 * chosen[q[i : i + k]]
        }
        rows = []
        for p, a in chosen.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return out
