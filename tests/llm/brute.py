"""Plain Python versions of what the operators' queries return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(UP) if lower else text)


def line_dedup(docs, min_docs=10, min_chars=1):
    keys = [[x.strip(SPACE).translate(UP) for x in (t or "").split("\n")] for _, t in docs]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for (i, t), ks in zip(docs, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not (len(k) >= min_chars and seen[k] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_dup(docs, percent=75):
    sets = {i: shingles(t) for i, t in docs}
    index, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            index[x].append(i)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def secret_spans(text):
    text = text or ""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18),
            ("hex", r"[0-9a-f]+", 0, 16),
        ]
    ):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    out.sort()
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in out)
    count = Counter(k for *_, k in out)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(text.encode()).hexdigest(), text


def measures(text):
    w = words(text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n
