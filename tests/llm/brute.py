"""Plain versions of the operators, for small inputs."""

import re

from cellsift.llm import decontaminate as dec


def shingles(text, k=5):
    if text is None:
        return frozenset()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, k=5, percent=80):
    """docs: (doc_id, text). doc_id -> (set size, component)."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    posts = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            posts.setdefault(g, []).append(i)
    links = set()
    for own in posts.values():
        links.update((i, j) for a, i in enumerate(own) for j in own[a + 1 :])
    good = []
    for i, j in links:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= percent * len(a | b):
            good.append((sets[i][0], sets[j][0]))
    comp = roots({d for d, _ in sets}, good)
    return sorted((d, len(s), comp[d]) for d, s in sets)


def template_tokens(text):
    """Raw tokens as (kind, value), and the template's as (kind, value, first, last)."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text)]
    raw = []
    for k, (a, b, w) in enumerate(found):
        low = w.lower()
        kind = dec.WORD
        if w[0].isdigit() or low in dec.NUMBERS:
            kind = dec.NUMBER
        elif raw and raw[-1][0] == dec.NUMBER and low in dec.UNITS:
            kind = dec.UNIT
        elif len(w) > 1 and w[0].isupper() and w[1].islower() and low not in dec.FUNCTION_WORDS:
            kind = dec.NAME
        raw.append((kind, low))
    out = []
    for k, (kind, low) in enumerate(raw):
        between = text[found[k - 1][1] : found[k][0]] if k else "."
        if out and out[-1][0] == kind and between and (kind == dec.NAME and not between.strip(" ") or kind == dec.NUMBER and not between.strip(" -")):
            out[-1] = (kind, (*out[-1][1], low), out[-1][2], k + 1)
        else:
            out.append((kind, (low,), k, k + 1))
    return raw, out


def pair_of(document, item):
    """covered and kind of one document and one item, or None: every window of one against every window of the other."""
    (raw_d, tem_d), (raw_i, tem_i) = template_tokens(document), template_tokens(item)
    size = len(raw_i)
    if not size:
        return None
    every, equal = set(), set()
    for plain in (True, False):
        own, other = ([(dec.WORD, (low,), k, k + 1) for k, (_, low) in enumerate(x)] if plain else t for x, t in ((raw_i, tem_i), (raw_d, tem_d)))
        length = min(dec.LENGTH, len(own))
        along = {}
        for a in range(len(own) - length + 1):
            x = own[a : a + length]
            words = sum(t[0] == dec.WORD for t in x)
            if not plain and (words < min(dec.LITERALS, length) or words == length):
                continue
            for b in range(len(other) - length + 1):
                y = other[b : b + length]
                if all(s[0] == t[0] and (s[0] != dec.WORD or s[1] == t[1]) for s, t in zip(x, y)):
                    ranges, pairs = along.setdefault(b - a, (set(), set()))
                    ranges.update(range(x[0][2], x[-1][3]))
                    pairs.update((s[0], s[1], t[1]) for s, t in zip(x, y) if s[0] != dec.WORD)
        for ranges, pairs in along.values():
            named = {p for p in pairs if p[0] != dec.NUMBER}
            if len({p[:2] for p in pairs}) == len(pairs) and len({(p[0], p[2]) for p in named}) == len(named):
                every |= ranges
                if all(p[1] == p[2] for p in pairs):
                    equal |= ranges
    enough = lambda n: n >= dec.TOKENS or n >= size * dec.SHARE
    return (len(every), "exact" if equal == every else "reparameterised") if enough(len(every)) else None
