"""Plain Python versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = words(lower(text))
    if len(w) >= size:
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def near_copies(rows, size, percent=80):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def removed_lines(rows, percent=90, least=3):
    """{doc_id: line numbers that go} of (doc_id, text) rows with distinct ids."""
    lines = [(i, n, set(words(x))) for i, t in sorted(rows) if t is not None for n, x in enumerate(t.split("\n")) if len(words(x)) >= least]
    out = {i: [] for i, _ in rows}
    for k, (i, n, s) in enumerate(lines):
        if any(100 * len(s & o) >= percent * len(s | o) for _, _, o in lines[:k]):
            out[i].append(n)
    return out


def text_stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)
