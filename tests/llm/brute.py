"""Plain versions of the operators, row by row, for small inputs."""

import hashlib
import re

UPPER = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate(UPPER).encode()


def words(text):
    return ALNUM.findall(lowered(text))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def contamination(docs, items, window=10):
    """{row: (n_words, n_hit, sorted item ids)}"""
    windows = []
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            windows += [(item, w[k : k + n]) for k in range(len(w) - n + 1)]
    out = {}
    for row, text in enumerate(docs):
        w = words(text)
        hit, found = set(), set()
        for item, part in windows:
            for k in range(len(w) - len(part) + 1):
                if w[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(item)
        out[row] = len(w), len(hit), sorted(str(i) for i in found if i is not None)
    return out


def shingles(text, k):
    w = BLANK.findall(lowered(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near(docs, k, num, den):
    """Component (smallest id) of each of [(id, text)], by comparing all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else docs[i][0]) for i in range(len(docs))]


def license_places(text, phrases):
    w = [x.decode() for x in words(text)]
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), sorted(found)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(UPPER), path


def url_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kneser_ney(trusted, order, start=0xFF):
    """Chance of a byte after a history, of a model trained on a list of byte strings."""
    from collections import Counter, defaultdict

    pad = bytes([start]) * (order - 1)
    top = Counter()
    for text in trusted:
        whole = pad + text
        for i in range(len(text)):
            top[whole[i : i + order]] += 1
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, counts in levels.items():
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
        one = lambda k, c=c, y=y: min(k - 0.05, max(0.05, k - (k + 1) * y * c[k + 1] / c[k])) if c[k] else 0.5
        discount[n] = [0, one(1), one(2), one(3)]
    total, left = defaultdict(int), defaultdict(float)
    for n, counts in levels.items():
        for g, c in counts.items():
            total[n, g[:-1]] += c
            left[n, g[:-1]] += discount[n][min(c, 3)]

    def chance(gram):
        if not gram:
            return 1 / 256
        n, context = len(gram), gram[:-1]
        below = chance(gram[1:])
        if (n, context) not in total:
            return below
        c = levels[n][gram]
        share = (c - discount[n][min(c, 3)]) / total[n, context] if c else 0
        return share + left[n, context] / total[n, context] * below

    return chance


def line_dedup(texts, threshold, min_chars):
    """[(n_lines, n_dropped, kept)]"""
    from collections import Counter

    lines = [(t or "").split("\n") for t in texts]
    key = lambda line: line.translate(UPPER).strip(" \t\n\x0b\x0c\r")
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    kept = [[x for x in ls if seen[key(x)] < threshold] for ls in lines]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(lines, kept, strict=True)]


def ranking(docs, items, top):
    """[(item_id, rank, doc_id, score)] of [(id, text)] each, by scoring everything."""
    from collections import Counter
    from math import floor, log

    docs = [(d, words(t)) for d, t in docs]
    docs = [(d, Counter(w), len(w)) for d, w in docs if w]
    df = Counter(t for _, w, _ in docs for t in w)
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    weigh = lambda t: floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        found = []
        for d, w, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_words
            score = sum(weigh(t) * (10**9 * w[t] // (1000 * w[t] + 12 * m)) for t in words(text))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, -score) for k, (score, _, d) in enumerate(found[:top], 1)]
    return out


def divergence(rows, min_docs, top):
    """{(lang, source, part, item, value, rank)} of [(text, lang, source)]."""
    from collections import Counter, defaultdict

    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, uses, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(term.findall(lowered(text)))
        groups[lang].add(source)
        df.update((lang, t) for t in found)
        uses[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        whole = Counter({t: sum(uses[lang, s][t] for s in sources) for t in kept})
        share = lambda c, kept=kept: {
            t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept
        }
        p, q = {s: share(uses[lang, s]) for s in sources}, share(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            more = [(-far(p[s][t], q[t]), t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out |= {(lang, s, part, x.decode(), -v, k) for k, (v, x) in enumerate(found, 1)}
    return out
