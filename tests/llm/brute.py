"""Plain versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib


def remove_repeats(texts: dict[int, str | None], width: int):
    seen, out = {}, {}
    words = {d: (texts[d] or "").encode().split() for d in sorted(texts)}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def remove_shared(texts: dict[int, str | None], width: int):
    first, out = {}, {}
    data = {d: (texts[d] or "").encode() for d in sorted(texts)}
    for d, b in data.items():
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != d:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def near_duplicates(texts: dict[int, str | None], budget: int = 3):
    import xxhash

    prints = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {d: d for d in texts}
    changed = True
    ids = sorted(texts)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= budget]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {d: (f"{prints[d]:016x}", root[d]) for d in texts}


def token_output(texts: dict[int, str | None], path: str):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(path), 0, {}
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def piece_digests(texts: dict[int, str | None], path: str):
    import numpy as np
    import sentencepiece

    sp, out = sentencepiece.SentencePieceProcessor(model_file=path), {}
    for d, t in texts.items():
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    return out


def base_secrets(text: str | None):
    import re

    text, spans = text or "", []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    spans += [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def quality(text: str | None):
    """n_words, n_repeat_words, words in repeats of 20, longest repeat."""
    w = (text or "").encode().split()

    def inside(n):
        seen, out = {}, set()
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                out |= {p for i in places for p in range(i, i + n)}
        return len(out)

    longest = 0
    while inside(longest + 1):
        longest += 1
    return len(w), inside(8), inside(20), longest


def linked_sets(texts: dict[int, str | None], percent: int, words: int):
    """Number of distinct shingles and smallest id of the group of each text, by all pairs."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return {d: (len(sets[d]), root[d]) for d in texts}


def prefix_trie(rows, period: int = 20, most: int = 4):
    """rows of conv_id, turn, role, text; with the borrowing of the registered query."""
    import zlib

    turns = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            turns.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = tuple(turns.get(c - c % period, [])[:h] + own[h:])
    in_node, ends = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            in_node.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(in_node, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + (len(in_node[node]) - 1) * words
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return [(min(c), len(n), min(in_node[n[:-1]]) if n else None, len(c), children.get(n, 0), leaves[n], saved[n], digest(n)) for n, c in in_node.items()]


def spelling_groups(texts: dict[int, str | None], shortest: int = 6, least: int = 5, times: int = 5, every: int = 199):
    """Every word against every other."""
    import re
    import zlib
    from collections import Counter

    counts = Counter()
    for d, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(x, w)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], words.get(form[w]))
    return out
