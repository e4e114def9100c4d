"""Plain statements of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(text):
    return PLAIN.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def pii(text):
    text = text or ""

    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0

    count = lambda s: len(re.sub("[^0-9]", "", s))
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p.lstrip("0")[:9] or 0) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count(s) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def substring(docs, window=35):
    words = [plain(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(docs, benchmark, window=10):
    patterns = {}
    for item, text in benchmark:
        w = alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            patterns.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = alnum(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in patterns:
                    hit.update(range(i, i + size))
                    items |= patterns[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return out


def licenses(text):
    w = alnum(text)
    at = []
    labels = set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        if found:
            labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def shingles(text, size=5):
    w = plain((text or "").translate(UPPER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in inverted[x] if j > i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]


def counts(text):
    text = text or ""
    w = plain(text)
    rows = [x for x in text.split("\n") if PLAIN.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(again)


def edit_within_one(a, b):
    """Whether two word lists differ by at most one inserted, deleted or replaced word."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def line_dedup(docs, least=8):
    """(doc_id, removed line numbers) of every row: lines with words that an earlier line (by doc_id, number) is within the bound of."""
    rows = sorted({(doc, i, tuple(plain(x))) for doc, text in docs for i, x in enumerate((text or "").split("\n")) if plain(x)}, key=lambda r: r[:2])
    gone = set()
    for n, (doc, i, w) in enumerate(rows):
        for d2, i2, v in rows[:n]:
            if (d2, i2) < (doc, i) and (v == w or (min(len(v), len(w)) >= least and edit_within_one(list(v), list(w)))):
                gone.add((doc, i, w))
                break
    return [(doc, [i for i, x in enumerate((text or "").split("\n")) if (doc, i, tuple(plain(x))) in gone]) for doc, text in docs]


def rule_features(text):
    """The features of the quality rules, by their definitions."""
    import math

    text = text or ""
    w = plain(text)
    n, chars, symbols, dup, again = counts(text)
    rows = sum(bool(PLAIN.search(x)) for x in text.split("\n"))
    nw, nc, nl = max(n, 1), max(chars, 1), max(rows, 1)
    of = lambda s: sum(c in s for c in text)
    lone = sum(len(x) == 1 and x in "#*$%&|<>" for x in w)
    return [math.log1p(n), chars / nw, symbols / nc, dup / nl, again / nw, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / nc, of("0123456789") / nc, of(".,;:!?") / nw, of("!?") / nw, len(set(w)) / nw, lone / nw, n / nl]


def tree_score(trees, x):
    """Probability of label 1: every tree is walked node by node."""
    import math

    margin = trees.bias
    for feature, cut, leaf in zip(trees.feature.tolist(), trees.cut.tolist(), trees.leaf.tolist(), strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-max(-30, min(30, margin))))


def passage_inputs(words, n_words):
    """The first twelve inputs of a passage, by their definitions."""
    import math

    size, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    of = lambda s: sum(c in s for w in words for c in w)
    lone = sum(len(w) == 1 and w in "#*$%&|<>" for w in words)
    same = sum(a == b for a, b in zip(words[1:], words[:-1], strict=True))
    ones = Counter(words)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(threes)
    return [
        math.log1p(len(words)) / 4, chars / size / 8, of("#*$%&|<>") / chars * 4, lone / size * 4, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars * 2, of("0123456789") / chars * 4,
        of(".,;:!?") / size * 2, of("!?") / size * 2, same / size * 4, sum(ones[w] > 1 for w in words) / size, sum(many[w] > 1 for w in threes) / size * 2, math.log1p(n_words) / 8]


def attention_score(p, bag):
    """Score of a bag of passages by gated attention, unit by unit."""
    import math

    def layer(v, matrix, bias):
        return [sum(a * matrix[i][j] for i, a in enumerate(v)) + bias[j] for j in range(len(bias))]

    p = {k: v.tolist() for k, v in p.items()}
    zero = [0.0] * len(p["b"])
    hidden = [[math.tanh(a) for a in layer(x, p["W"], p["b"])] for x in bag]
    energy = []
    for h in hidden:
        gate = [1 / (1 + math.exp(-a)) for a in layer(h, p["U"], zero)]
        energy.append(sum(math.tanh(a) * g * w for a, g, w in zip(layer(h, p["V"], zero), gate, p["w"], strict=True)))
    weight = [math.exp(e - max(energy)) for e in energy]
    z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(zero))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * c for a, c in zip(z, p["c"], strict=True)) + p["d"]))))
