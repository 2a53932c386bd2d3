"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def repeated_cover(sequences: list, window: int) -> list[list[bool]]:
    seen = Counter(bytes(s[i : i + window]) if isinstance(s, bytes) else tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[bytes(s[i : i + window]) if isinstance(s, bytes) else tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def op2(rows: list[tuple]) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, gone in zip(rows, texts, repeated_cover(texts, 200), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip([False, *gone], gone, strict=False))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op8(rows: list[tuple]) -> list[tuple]:
    words = [(t or "").encode().split() for _, t in rows]
    out = []
    for (doc, _), w, gone in zip(rows, words, repeated_cover(words, 35), strict=True):
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def op6(rows: list[tuple], size: int = 4) -> list[tuple]:
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            where[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least.get(root(i)) if s else doc, (doc == least.get(root(i))) if s else True) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def op1_base(text: str | None) -> tuple:
    import re

    kinds = (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    spans = sorted((m.start(), r, m.end(), k) for r, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= n)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*(sum(s[3] == k[0] for s in spans) for k in kinds), hashlib.sha256(joined.encode()).hexdigest(), joined)


def op3(rows: list[tuple]) -> dict:
    """Targets by the rule as it is told: share by weight, cut at three times the size, share the rest again."""
    sizes: dict = defaultdict(int)
    for source, text in rows:
        sizes[source] += len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + share * weight[s] >= 3 * sizes[s]}
        for s in over or free:
            more = min(share * weight[s], 3 * sizes[s] - target[s]) if over else share * weight[s]
            target[s] += more
            left -= more
        if not over:
            break
        free -= over
    return {s: (sizes[s], target[s]) for s in names}


def op5(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    import re

    def words(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for n in lengths:
                if i + n <= len(w) and (ids := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def op7(rows: list[tuple]) -> list[tuple]:
    import zlib
    from math import log10

    def held(doc) -> bool:
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1

    c: Counter = Counter()
    for doc, t in rows:
        if not held(doc):
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for doc, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out.append((doc, held(doc), len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def op9(html: str) -> str:
    """The blocks of the one article that a page has, by regular expressions."""
    import html as entities
    import re

    inside = re.search("<article>(.*)</article>", html, re.S)[1]
    inside = re.sub("<!--.*?-->", "", inside, flags=re.S)
    for name in ("script", "style", "form", "aside", "nav", "footer"):
        inside = re.sub(f"<{name}\\b.*?</{name}>", "", inside, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|table|tr|td|blockquote|pre|article)\b[^>]*>", inside)
    texts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def op10(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    keys = []
    for doc, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        keys.append(low)
        groups[low].append(doc)
    keep = {k: max((d for d in ds if d is not None), default=None) for k, ds in groups.items()}
    return [(doc, keep[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for (doc, _), k in zip(rows, keys, strict=True)]


def log10_forward(start, move, emit, seq) -> float:
    """Sum over all paths, without scaling, for short sequences."""
    import math

    alpha = [s * emit[k][seq[0]] for k, s in enumerate(start)]
    for x in seq[1:]:
        alpha = [sum(a * move[j][k] for j, a in enumerate(alpha)) * emit[k][x] for k in range(len(start))]
    return math.log10(sum(alpha))


def op13(docs: list[tuple], items: list[str | None], least: int = 20, share: int = 5, buckets: int = 10000) -> list[tuple]:
    import math
    import re
    import zlib

    def words(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(t: str | None) -> list[int]:
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, d in docs for x in features(d)), Counter(x for d in items for x in features(d))
    sums, sumt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * sumt_inv)) for x, sumt_inv in ((x, sums / ((s[x] + 1) * sumt)) for x in f))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(best[: len(best) * share // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def near(u: str, v: str) -> bool:
    """One inserted, deleted or replaced code point, by trying them all."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def op12(rows: list[tuple], least: int = 7) -> list[tuple]:
    import re
    import zlib

    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    form, links = {}, {}
    for w, n in words.items():
        links[w] = [x for x in words if near(w, x)]
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, len(links[w]), form[w] and words[form[w]]) for w, n in words.items()]


def contexts(texts: list[str], places, signs, class_of, classes: int, dims: int, reach: int):
    """Sums of neighbours' index vectors, token by token."""
    import re

    out = [[0] * dims for _ in range(classes)]
    for text in texts:
        own = [class_of(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^ \t\n\r\x0b\x0c0-9A-Za-z\x80-\U0010ffff]+", text)]
        for i, c in enumerate(own):
            for j in range(max(0, i - reach), min(len(own), i + reach + 1)):
                if i != j:
                    for p, s in zip(places[own[j]], signs[own[j]], strict=True):
                        out[c][p] += int(s)
    return out


def op4(rows: list[tuple], switch: float = 12.0) -> list[tuple]:
    """Naive Bayes over hashed grams of words and the best path over a text, word by word. rows: id, text, lang."""
    import math
    import unicodedata
    import zlib

    from quarrion.llm.language_id import SCRIPT_SHARE, script_of

    def words(text: str | None) -> list[str]:
        out, word = [], ""
        for c in (text or "").lower():
            letter = c.isalnum() and unicodedata.category(c) != "Nd"
            if letter or (word and (unicodedata.category(c)[0] == "M" or c in "‌‍")):
                word += c
            else:
                out, word = ([*out, word] if word else out), ""
        return [*out, word] if word else out

    def cells(word: str) -> list[int]:
        b = b"\x01\x01" + word.encode() + b"\x01\x01"
        three = [int.from_bytes(b[i : i + 3], "little") for i in range(len(b) - 3)]
        four = [int.from_bytes(b[i : i + 4], "little") ^ 0x5BD1E995 for i in range(len(b) - 3)]
        return [(x * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for x in three + four]

    def crc(doc) -> int:
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5

    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and crc(doc):
            grams[lang], scripts[lang]
            for w in words(text):
                grams[lang].update(cells(w))
                scripts[lang][script_of(w[0])] += 1
    langs = sorted(grams)
    total = {k: sum(grams[k].values()) + 0.5 * 65536 for k in langs}

    def scored(word: str) -> tuple[list[float], bool]:
        sums = [sum(math.log((grams[k][c] + 0.5) / total[k]) for c in cells(word)) for k in langs]
        uses = [scripts[k][script_of(word[0])] / max(1, sum(scripts[k].values())) >= SCRIPT_SHARE for k in langs]
        if not any(uses):
            return [0.0] * len(langs), False
        own = [s for s, u in zip(sums, uses, strict=True) if u]
        return [s - max(own) if u else min(own) - 1e4 - max(own) for s, u in zip(sums, uses, strict=True)], True

    out = []
    for doc, text, _ in rows:
        own = words(text) if langs else []
        if not own:
            out.append((doc, crc(doc) == 0, "und", 0.0))
            continue
        each = [scored(w) for w in own]
        value, came = each[0][0], []
        for s, _ in each[1:]:
            top = max(range(len(langs)), key=lambda k: value[k])
            came.append([k if value[k] >= value[top] - switch else top for k in range(len(langs))])
            value = [max(value[k], value[top] - switch) + s[k] for k in range(len(langs))]
        state = max(range(len(langs)), key=lambda k: value[k])
        path = [state]
        for step in reversed(came):
            path.append(step[path[-1]])
        share = [sum(len(w) for w, (_, known), p in zip(own, each, path[::-1], strict=True) if known and p == k) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: share[k])
        out.append((doc, crc(doc) == 0, langs[best], share[best] / sum(map(len, own))))
    return out


def mixed(rows: list[tuple]) -> Counter:
    """Words taken by id. rows: id, text, source."""
    targets = op3([(s, t) for _, t, s in rows])
    per = defaultdict(list)
    for doc, text, source in rows:
        digest = hashlib.md5((text or "").encode()).hexdigest()
        key = hashlib.md5("|".join(["mix", *([] if doc is None else [str(doc)]), digest]).encode()).hexdigest()
        per[source].append((key, doc is not None, doc or 0, len((text or "").encode().split()), doc))
    queue = []
    for source, docs in per.items():
        size, target = targets[source]
        served = 0
        for rank, (_, _, _, n, doc) in enumerate(sorted(docs, key=lambda x: x[:4])):
            served += n
            queue += [((copy * size + served) / target, source is None, (source or "").encode(), rank, copy, n, doc) for copy in range(3) if n]
    budget, done, taken = sum(x[3] for docs in per.values() for x in docs), 0, Counter()
    for *_, n, doc in sorted(queue, key=lambda x: x[:5]):
        done += n
        if 2 * done - n <= 2 * budget:
            taken[doc] += n
    return taken
