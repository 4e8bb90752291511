"""Plain restatements of the rules, for small inputs."""

import math
import os.path
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

GAP = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in GAP.split((text or "").translate(LOWER)) if w]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def counted_shingles(text, size=5):
    """Shingles with their numbers of times, as a set of pairs of a shingle and which time it is."""
    w = words(text)
    found = [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    seen = Counter()
    return {(x, seen.update([x]) or seen[x]) for x in found}


def classes(rows, threshold=0.8, counted=True):
    """id -> least id of the component, by comparing all pairs."""
    sets = [(i, (counted_shingles if counted else shingles)(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and len(s & t) >= threshold * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def contamination(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        u = words(t)
        if not u:
            continue
        n = min(size, len(u))
        wins = {tuple(u[i : i + n]) for i in range(len(u) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def base_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 3000 else {x for x, n in __import__("collections").Counter(wins).items() if n > 1}
    hit = {j for i, x in enumerate(wins) if x in twice for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


class Lines(HTMLParser):
    """Lines with the kind of place that they are in: out, open or core. For pages whose elements are closed, but p and li."""

    BLOCKS = "html head body div p ul li nav header footer aside form article main h1 h2 h3 section title script style label input meta".split()

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.path = [], "", []
        self.feed(page)
        self.close()
        self.flush()

    def kind(self):
        kinds = ["out" if t in "head nav footer aside form script style title".split() or (t == "header" and "article" not in self.path[:i]) or c in ("ad", "cookie-notice", "comments") else "core" if t in ("article", "main") else "" for i, (t, c, _) in enumerate(self.path)]
        return "out" if "out" in kinds else "core" if "core" in kinds else "open"

    def flush(self):
        text = " ".join(self.text.split())
        if text and not {"script", "style", "title"} & {t for t, _, _ in self.path}:
            self.lines.append((text, self.kind(), tuple((t, re.sub("[0-9]+", "#", c)) for t, _, c in self.path)))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        if tag not in self.BLOCKS:
            return
        self.flush()
        if self.path and (self.path[-1][0] == "p" or self.path[-1][0] == tag == "li"):
            self.path.pop()
        if tag not in ("input", "meta"):
            self.path.append((tag, dict(attrs).get("class") or dict(attrs).get("id") or "", dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
            if tag in [t for t, _, _ in self.path]:
                while self.path.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        self.text += data


def common(a, b, meet=lambda x, y: x == y):
    """Places in a of a longest common subsequence, by the whole table; a common start first."""
    n = 0
    a, b = list(enumerate(a)), list(b)
    a, b = [(i, x) for i, x in a if any(meet(x, y) for y in b)], [y for y in b if any(meet(x, y) for _, x in a)]
    while n < min(len(a), len(b)) and meet(a[n][1], b[n]):
        n += 1
    head, a, b = [i for i, _ in a[:n]], a[n:], b[n:]
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (_, x) in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if meet(x, y) else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if t[i][j] == t[i][j - 1]:
            j -= 1
        elif t[i][j] == t[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(a[i][0])
    return head + out[::-1]


def main_text(rows):
    """id -> main text and number of lines that the neighbour has, each page looked at with all others of its host; ids are unique."""
    pages = []
    for i, url, page in rows:
        lines = Lines(page).lines
        core = "core" if any(k == "core" for _, k, _ in lines) else "open"
        keys = [(n, t, s if core == "core" or k == "out" else None) for n, (t, k, s) in enumerate(lines) if k != "core"]
        pages.append({"id": i, "host": urlsplit(url).netloc, "path": urlsplit(url).path, "url": url, "lines": lines, "own": [t for t, k, _ in lines if k == core], "core": core, "keys": keys})

    def copies(p, q):
        total = sum(map(len, p["own"] + q["own"]))
        return not total or 2 * sum(len(p["own"][i]) for i in common(p["own"], q["own"])) >= 0.7 * total

    def meet(x, y):
        return x[1] == y[1] or (x[2] is not None and x[2] == y[2])

    out = {}
    for p in pages:
        host = sorted((q for q in pages if q["host"] == p["host"]), key=lambda q: (q["path"], q["url"], q["id"]))
        nodes = [q for n, q in enumerate(host) if q["lines"] not in [x["lines"] for x in host[:n]] and q["lines"]]
        at = next((n for n, q in enumerate(nodes) if q["lines"] == p["lines"]), None)
        around = []
        for step in (-1, 1) if at is not None else ():
            n = at
            while 0 <= n + step < len(nodes) and copies(nodes[n], nodes[n + step]):
                n += step
            if 0 <= n + step < len(nodes):
                around.append((nodes[n + step]["path"] != nodes[at]["path"], len(os.path.commonprefix([nodes[n + step]["path"], nodes[at]["path"]])), step == -1, nodes[n + step]))
        shared = set()
        if around:
            q = max(around, key=lambda x: x[:3])[3]
            shared = {p["keys"][n][0] for n in common(p["keys"], q["keys"], meet)}
            # of boilerplate that is left, all that the neighbour has anywhere, and all that stands where such stands
            shared |= {n for n, t, s in p["keys"] if s is not None and any(meet((n, t, s), y) for y in q["keys"])}
            slots = {s for n, _, s in p["keys"] if s is not None and n in shared}
            shared |= {n for n, _, s in p["keys"] if s is not None and s in slots}
        own = [(n, t) for n, (t, k, _) in enumerate(p["lines"]) if k == p["core"]]
        left = [t for n, t in own if n not in shared] or [t for _, t in own]
        out[p["id"]] = ("\n\n".join(left), len(shared))
    return out


def hits(line, entries, exceptions):
    """How often each entry begins a word of a folded line, outside phrases; by looking at every place."""
    padded, out = f" {line} ", Counter()
    at = lambda x: [i for i in range(len(padded)) if padded.startswith(x, i)]
    spans = [(i, i + len(p) + 2) for p in exceptions for i in at(f" {p} ")]
    for p in entries:
        for i in at(f" {p}"):
            if not any(a <= i and i + len(p) + 1 <= b for a, b in spans):
                out[p] += 1
    return out


def toxic_score(line, model):
    """The score of a folded line: likelihood ratios of what it has more of than a clean text of its length."""
    found, n, x = hits(line, model.rates, model.exceptions), len(line.split(" ")), 0.0
    for p, c in found.items():
        usual = n * model.rates[p]
        x += c * math.log(c / usual) - (c - usual) if c > usual else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * math.log(1 + x))))), sum(found.values())


def periodic_runs(words, least=6, periods=4):
    """(start, length, period) of every run, by trying every period."""
    out = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in out.items())


def simhash(text, size=4):
    """The fingerprint, bit by bit."""
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def near_components(prints, distance=4):
    """Row -> least row that is linked to it, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]
