"""Plain versions of the operators, straight from their definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def near(docs, width=2, percent=80):
    """id -> (number of shingles, smallest id reachable)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def repeats(docs, length=50):
    """(id, text) -> n_bytes, n_removed, n_spans, sha256 of the rest."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    first: dict[bytes, int] = {}
    for i, b in raw:
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base_secrets(text):
    """(start, rank, end, kind) of the base spans."""
    text, out = text or "", []
    patterns = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16)]
    for rank, (kind, p, group, least) in enumerate(patterns):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text) if len(m[group]) >= least]
    return sorted(out)


def license_base(text):
    """n_words, places of base phrases (start, label)."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def brute_site_texts(pages, fixed):
    """Texts of a host's pages, trees of (style, children or text), without its unimportant branches. ``fixed``: the module with the thresholds."""
    from math import log

    def branches(tree, chain=()):
        chain = (*chain, tree[0])
        yield chain, tree
        for child in tree[1] if isinstance(tree[1], list) else ():
            yield from branches(child, chain)

    def texts(tree, chain=()):
        return [(c, " ".join(t[1].split())) for c, t in branches(tree, chain) if isinstance(t[1], str)]

    m = len(pages)
    wrapped = [("", [p]) for p in pages]
    chains = {c for p in wrapped for c, _ in branches(p)}
    on = {c: [p for p in wrapped if any(x == c for x, _ in branches(p))] for c in chains}

    def carrying(chain, text):
        return sum((chain, text) in texts(p) for p in wrapped)

    seen = {key: carrying(*key) for key in {x for p in wrapped for x in texts(p)}}

    def facts(chain):
        """Entropy of styles, mean importance of the branch's words, and the branch's information on a page."""
        styles, words, lost = {}, 0, 0.0
        for p in on[chain]:
            here = [t for c, t in branches(p) if c == chain]
            style = tuple(x[0] for t in here if isinstance(t[1], list) for x in t[1])
            styles[style] = styles.get(style, 0) + 1
            said = [(c, t) for c, t in texts(p) if c[: len(chain)] == chain]
            words += sum(len(t.split()) for _, t in said)
            lost += sum(len(t.split()) * log(seen[c, t]) for c, t in set(said))
        n = len(on[chain])
        content = 1 - lost / log(m) / words if words else 1.0
        return -sum(k / n * log(k / n) for k in styles.values()), content, content * words / n, words

    def kept(tree, chain, parent):
        chain = (*chain, tree[0])
        if parent is not None and m > 1 and whole > 1e-9 * total / m:
            entropy, content, info, words = facts(chain)
            template = facts(parent)[0] <= log(fixed.STYLES)
            textual = tree[0].split(".")[0] in fixed.TEXTUAL
            limit = fixed.REPEATED if template else 0.0 if textual else fixed.CONSTANT
            if words and content < limit and info < fixed.SHARE * whole:
                return []
        if isinstance(tree[1], str):
            return [" ".join(tree[1].split())]
        inner = [line for child in tree[1] for line in kept(child, chain, chain)]
        if tree[0].split(".")[0] != "span" and inner and all(x[0].split(".")[0] == "span" for x in tree[1]):
            return ["".join(inner)]  # inline children are one block
        return inner

    _, _, whole, total = facts(("",)) if m > 1 else (0.0, 1.0, 0.0, 0)
    return ["\n".join(x for x in kept(p, (), None) if x) for p in wrapped]
