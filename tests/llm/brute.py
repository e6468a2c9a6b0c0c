"""Plain Python restatements of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import regex

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) == 1 and b[k + 1 :] == a[k:]


def line_dedup(rows, order=None, min_chars=1):
    """{(id, text, line number)} -> (keeper id, keeper line, distance); rows: distinct (id, text). ``order`` ranks the
    texts of one id."""
    order = order or {}
    lines = [((i, n, order.get(t, 0)), t, x) for i, t in set(rows) if i is not None and t is not None for n, x in enumerate(t.split("\n")) if words(x)]
    first = {}
    for at, _, x in sorted(lines, key=lambda r: r[0]):
        first.setdefault(x, at)
    by_size = {}
    for x in first:
        by_size.setdefault(len(x), []).append(x)
    near = {}
    for x, at in first.items():
        if len(x) >= min_chars:
            own = [first[y] for k in (-1, 0, 1) for y in by_size.get(len(x) + k, []) if len(y) >= min_chars and first[y] < at and one_edit(x, y)]
            if own:
                near[x] = min(own)
    out = {}
    for at, t, x in lines:
        if x in near:
            out[at[0], t, at[1]] = (*near[x][:2], 1)
        elif at != first[x]:
            out[at[0], t, at[1]] = (*first[x][:2], 0)
    return out


def drop_lines(rows, gone):
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)) for i, t in rows]


def shingles(text, size):
    w = words((text or "").translate(UPPER))
    if not w:
        return set()
    size = min(size, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(sets, percent):
    ids = sorted(sets, key=lambda i: len(sets[i]))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if not a or 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def components_of_rows(rows, size, percent):
    """{id: component}: as ``components``, where an id may have several texts."""
    rows = [(i, t) for i, t in rows if i is not None]
    own = components({k: shingles(t, size) for k, (_, t) in enumerate(rows)}, percent)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        x, y = root(i), root(rows[own[k]][0])
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def tokens(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def holds(text, item, min_tokens=8, min_share=0.7, window=20, window_share=0.8):
    """Whether a text holds a benchmark item along some alignment."""
    t, b = tokens(text), tokens(item)
    if len(b) < min_tokens:
        return False
    places = {}
    for k, x in enumerate(b):
        places.setdefault(x, []).append(k)
    hits = Counter(i - k for i, x in enumerate(t) for k in places.get(x, []))
    for start, n in hits.items():
        if n >= min_share * len(b):
            return True
        if len(b) > window and n >= window_share * window:
            same = [0 <= start + k < len(t) and t[start + k] == b[k] for k in range(len(b))]
            if any(sum(same[k : k + window]) >= window_share * window for k in range(len(b) - window + 1)):
                return True
    return False


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    at = Counter(zip(w, w[1:], w[2:]))
    inside = {k + o for k in range(len(w) - 2) if at[w[k], w[k + 1], w[k + 2]] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def mix_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """{source: target}; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), budget * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: per * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
        free -= full
    return target


def chunks(text, gear, min_bytes=12, avg_bytes=32, max_bytes=128):
    """[(start, end)] of a text's chunks: each ends at the first byte in reach whose gear hash is small, else at the
    smallest hash in reach, else at the end of the text."""
    raw = text.encode()
    hash_at = [sum(int(gear[raw[i - k]]) << k for k in range(min(i + 1, 16))) % 65536 for i in range(len(raw))]
    limit, out, last = 65536 // (avg_bytes - min_bytes), [], 0
    while last < len(raw):
        reach = range(last + min_bytes, min(last + max_bytes, len(raw)) + 1)
        end = next((c for c in reach if hash_at[c - 1] < limit), None)
        if end is None:
            end = len(raw) if len(raw) - last <= max_bytes else min(reach, key=lambda c: (hash_at[c - 1], c))
        out.append((last, end))
        last = end
    whole = lambda k: next(e for e in range(k, len(raw) + 1) if e == len(raw) or raw[e] & 0xC0 != 0x80)
    return [(whole(a), whole(b)) for a, b in out if whole(a) < whole(b)]


def spans(rows, gear, min_words=24):
    """{(id, text, start, bytes, keeper, cut)} of distinct (id, text) rows."""
    held, cut_up = {}, {}
    for i, t in set(rows):
        if i is not None and t:
            cut_up[i, t] = [(a, b, t.encode()[a:b]) for a, b in chunks(t, gear)]
            for _, _, x in cut_up[i, t]:
                held.setdefault(x, set()).add(i)
    out = set()
    for (i, t), own in cut_up.items():
        runs = []
        for a, b, x in own:
            if len(held[x]) > 1:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b, min(held[x])))
                else:
                    runs.append([(a, b, min(held[x]))])
        raw, gap = t.encode(), b" \t\n\v\f\r"
        count = lambda a, b: sum(raw[k] not in gap and (k == 0 or raw[k - 1] in gap) for k in range(a, b))
        for run in runs:
            if count(run[0][0], run[-1][1]) < min_words:
                continue
            for theirs, stretch in groupby(run, key=lambda c: c[2] < i):
                stretch = list(stretch)
                cut = theirs and count(stretch[0][0], stretch[-1][1]) >= min_words
                for keeper, piece in groupby(stretch, key=lambda c: c[2]):
                    piece = list(piece)
                    out.add((i, t, piece[0][0], piece[-1][1] - piece[0][0], keeper, cut))
    return out


def mix(rows, weights=(5, 2, 1), budget=1.5, most=2):
    """({source: target}, {(source, size): rate}, {(source, size): copies over all documents of that size}) of
    (source, size) rows. The tilt of a source is found by bisection."""
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets, rates, copies = mix_targets(sizes, weights, budget, most), {}, {}
    for s in sizes:
        count = Counter(n for x, n in rows if x == s)
        scale = sizes[s] / sum(count.values())
        rate = lambda a, n: min(float(most), math.exp(min(50.0, a * n / scale))) if scale else 0.0
        low, high = -1e6, 1e6
        full = targets[s] >= most * sizes[s] * (1 - 1e-12)
        while not full and high - low > 1e-13 * max(1.0, abs(low)):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            if sum(c * n * rate(mid, n) for n, c in count.items()) < targets[s]:
                low = mid
            else:
                high = mid
        carry = 0.0
        for n in sorted(count, reverse=True):
            rates[s, n] = (float(most) if full else rate(low, n)) if sizes[s] else 0.0
            want = count[n] * n * rates[s, n]
            k = min(max(math.floor((want + carry) / n + 0.5), 0), most * count[n]) if n else 0
            carry += want - k * n
            copies[s, n] = k
    return targets, rates, copies
