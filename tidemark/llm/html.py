"""Main text of web pages, by differencing with the page of the nearest URL, and by structure where that page can't tell.

A page is cut into blocks of text, its lines. Each has two keys: its text, and its slot, the path of the elements that it stands in with their classes, numbers masked. The lines outside the
article are aligned, by longest common subsequence, with those of the page whose URL is nearest on the same host; two lines meet if either key agrees, so a menu or an advert that is drawn
anew for each page meets that of the neighbour by its slot. What meets is deleted, and with it what stands in the same slot. Boilerplate left over is aligned again until none meets, so what stands in
another order is found too. Structure has two parts in this. It vetoes: what is inside an article (or main) element is never aligned, since articles of copied pages, or such as quote one passage,
share lines that are no boilerplate, and on a page without one slots count only inside menus, adverts and the like, since its content stands in the same slots as the neighbour's. And it settles
what no neighbour has: lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and what is outside the article of a page that has one.
What it can't tell the alignment alone decides: a page without an article, and, by both keys at once, what stands in a main element around an article that is most of it, where a headline or a lead may be as well as a notice.

Nearest means next to it in the order of host, path and whole URL; of the two neighbours, that with the longer common start of the path, the page
before on a tie, and one with the same path only if there is no other. Copies tell nothing about boilerplate: pages of a host with equal lines are one
node, and neighbours of which seven tenths of the content are the same form a run, whose members take the last page before it and the
first after it. The order comes from range partitions, so a host or a run of any size is spread over tasks, and only hashes and
sizes of lines are moved with it.
"""

from __future__ import annotations

import html
import os.path
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, saved, small_batches

# Names of elements and of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template textarea title head nav footer aside form button select option datalist iframe svg canvas object dialog menu map audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation navi menu menubar breadcrumb breadcrumbs footer sidebar side aside widget widgets "
    "related recommended recommendations comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing sharebar pagination pager toolbar masthead copyright search skip teaser disclaimer legal privacy paywall discussion responses reactions dropdown offcanvas adsbygoogle".split()
)
LAYOUT = frozenset("has with no without is".split())  # has-sidebar tells of a layout, not what an element is
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPECIAL = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LONG_REFERENCE = re.compile("&#(?:0*([0-9]{1,}?)(?![0-9])|[xX]0*([0-9a-fA-F]{1,}?)(?![0-9a-fA-F]));?")
#: Zones; MAIN is in a main element around the article.
OUT, UNDECIDED, ARTICLE, MAIN = 0, 1, 2, 3
#: Share of the content from which neighbours are copies of each other.
COPY = 0.7
#: Bits of a table that the alignment keeps at once; longer pages are halved first.
TABLE_BITS = 1 << 26


def _is_out(name: str, raw: str, inside: bool) -> bool:
    """Whether an element and all in it is boilerplate."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not raw or raw.isspace():
        return False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.strip() in ROLES):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = re.split("[^a-z0-9]+", word)
                if parts[0] in LAYOUT:
                    continue
                if CLASSES.intersection(parts) or (not inside and "header" in parts and not {"article", "post", "entry", "content"}.intersection(parts)):
                    return True
        elif key in ("class", "id") and name == "article" and {"comment", "comments", "reply", "teaser", "related", "ad", "promo"}.intersection(re.split("[^a-z0-9]+", value)):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends: after the next > outside quotes, or after any > where a quote isn't closed; -1 if there is none.

    A quote that isn't closed has no other of its kind behind it, so this looks to the page's end twice at most.
    """
    while m := SPECIAL.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end()) + 1 or -1
        at = close + 1
    return -1


def _number(m: re.Match) -> str:
    """A numeric reference without leading zeros; one that is no character as the replacement character."""
    digits = m[1] or m[2]
    return "�" if len(digits) > 8 else f"&#{'' if m[1] else 'x'}{digits};"


def clean(text: str) -> str:
    """Character references decoded, white space as one space."""
    if "&" in text:
        text = html.unescape(LONG_REFERENCE.sub(_number, text) if "&#" in text else text)
    return " ".join(text.split())


def blocks(page: str) -> list[tuple[str, int]]:
    """Text and zone of each block of a page, in order."""
    return [(text, zone) for text, zone, _ in lines_of(page)]


def slot_of(above: int, name: str, raw: str) -> int:
    """The slot of what stands in an element: the slot of the element around it, its name and its classes with numbers masked."""
    m = CLASS.search(raw) if raw else None
    return xxhash.xxh64_intdigest(f"{name}.{re.sub('[0-9]+', '#', m[1] or m[2] or m[3] or '')}" if m else name, above)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """Text, zone and slot of each block of a page, in order. Every part of the page is looked at once."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # open elements with their zones and slots
    opened: Counter = Counter()  # how many of each name are open
    barred = 0  # open boilerplate elements that aren't forms
    never: set[str] = set()  # names that aren't closed any more
    zone, slot, parts, pos, n = UNDECIDED, 0, [], 0, len(page)

    def flush() -> None:
        if parts:
            text = clean("".join(parts))
            if text:
                out.append((text, zone, slot))
            parts.clear()

    def pop() -> None:
        nonlocal barred
        name, z, _ = stack.pop()
        opened[name] -= 1
        barred -= z == OUT and name != "form"

    while pos < n:
        m = START.search(page, pos)
        end = n if not m else m.end()
        if m and m[2] is None:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            end = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
        elif m:
            end = _tag_end(page, m.end())
            if end < 0:
                m = None  # no tag is closed any more: the rest is text
        if (m.start() if m else n) > pos:
            parts.append(page[pos : m.start() if m else n])
        if not m:
            break
        pos = end
        if m[2] is None:
            continue
        name, raw = m[2].lower(), page[m.end() : end - 1]
        if name in INLINE:
            if not m[1] and raw and zone and name not in never and _is_out(name, raw, zone >= ARTICLE):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                if close:
                    pos = close.end()
                else:
                    never.add(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        if m[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        else:
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            above, around = stack[-1][1:] if stack else (UNDECIDED, 0)
            if name in ("article", "main") and not above and not barred:
                above = UNDECIDED  # a form around the whole page
            own = OUT if not above or _is_out(name, raw, above >= ARTICLE) else ARTICLE if name == "article" else MAIN if above < ARTICLE and (name == "main" or (raw and re.search(r"""role\s*=\s*["']?main\b""", raw))) else above
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                pos = _tag_end(page, close.end()) if close else n
                pos = n if pos < 0 else pos
            elif name not in VOID and not raw.rstrip().endswith("/"):
                stack.append((name, own, slot_of(around, name, raw)))
                opened[name] += 1
                barred += own == OUT and name != "form"
        zone, slot = stack[-1][1:] if stack else (UNDECIDED, 0)
    flush()
    outer, inner = (sum(len(t) for t, z, _ in out if z == x) for x in (MAIN, ARTICLE))
    # a main element is the article itself unless articles have more text, so teasers in it change nothing
    return out if inner > outer else [(t, ARTICLE if z == MAIN else z, s) for t, z, s in out]


def content_zone(zones: list[int]) -> int:
    """The zone of a page's content: the article if it has one, else what is undecided. What is in a main element around the article is content too, unless the alignment tells else."""
    return ARTICLE if ARTICLE in zones else UNDECIDED


#: Of the content's lines hashes and code points; of those that may be aligned their places, hashes and slots (none where only the text counts).
LINES = "struct<content:struct<hashes:array<bigint>,sizes:array<int>>,open:struct<places:array<int>,hashes:array<bigint>,slots:array<bigint>>,n:int>"
KIND = pa.struct([("content", pa.struct([("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])), ("open", pa.struct([("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("slots", pa.list_(pa.int64()))])), ("n", pa.int32())])


def told(page: str | None) -> dict:
    """A page's lines as LINES has them: all outside the article may be aligned, by their slots too inside boilerplate and where the page has an article. In a main element around it a line has one key of its text and slot."""
    lines = [(xxhash.xxh64_intdigest(t, s if z == MAIN else 0) - 2**63, len(t), z, s - 2**63) for t, z, s in lines_of(page or "")]
    zone = content_zone([z for _, _, z, _ in lines])
    content = [x for x in lines if x[2] == zone]
    open_ = [(i, h, s if z == OUT or (zone == ARTICLE and z != MAIN) else None) for i, (h, _, z, s) in enumerate(lines) if z != ARTICLE]
    columns = lambda rows, names: {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return {"content": columns(content, ("hashes", "sizes")), "open": columns(open_, ("places", "hashes", "slots")), "n": len(lines)}


def _lines(pages: pa.Array) -> pa.Array:
    return pa.array([told(p) for p in pages.to_pylist()], KIND)


def _packed(pages: pa.Array) -> pa.Array:
    """The lines of each page, packed, since they may be shuffled: the zone's digit before each, no line ends in them."""
    pack, out = zstandard.ZstdCompressor(level=1, write_content_size=True), []
    for page in pages.to_pylist():
        out.append(pack.compress("\n".join(f"{z}{t}" for t, z in blocks(page or "")).encode("utf-8", "surrogatepass")))
    return pa.array(out, pa.binary())


def kept_lines(lines: list[str], shared: set[int], aligned: bool) -> tuple[list[str], int]:
    """What stays of lines with their zones' digits, and how many go by structure alone: shared lines go, unless nothing of the content would be left; what the neighbour can't tell structure settles."""
    zones = str(content_zone([int(x[0]) for x in lines])), str(MAIN)
    content = [i for i, x in enumerate(lines) if x[0] in zones]
    if aligned and content and shared.issuperset(content):
        shared = shared.difference(content)
    kept = [i for i, x in enumerate(lines) if (not aligned if i in shared else x[0] in zones)]
    return [lines[i][1:] for i in kept], len(lines) - len(kept) - (len(shared) if aligned else 0)


def left_udf(aligned: bool):
    """packed lines and places of shared ones -> text, and how many lines went by structure alone"""

    @F.arrow_udf("text string, n_settled long")
    def run(packed: pa.Array, shared: pa.Array) -> pa.Array:
        unpack, texts, settled = zstandard.ZstdDecompressor(), [], []
        for data, places in zip(packed.to_pylist(), shared.to_pylist()):
            lines = unpack.decompress(data).decode("utf-8", "replace")
            kept, n = kept_lines(lines.split("\n") if lines else [], set(places or ()), aligned)
            texts.append("\n\n".join(kept))
            settled.append(n)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(settled, pa.int64())], ["text", "n_settled"])

    return run


def _rows(a: list, masks: dict, width: int):
    """After each element of a: an integer whose bit j is zero where the common subsequence of a so far with b[:j + 1] is longer than with b[:j]."""
    v = full = (1 << width) - 1
    for x in a:
        m = 0
        for key in x:
            m |= masks.get(key, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list) -> dict:
    where: dict = {}
    for j, keys in enumerate(b):
        for y in set(keys):
            where.setdefault(y, []).append(j)
    out = {}
    for y, js in where.items():
        bits = np.zeros(len(b) // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, np.array(js) // 8, (1 << (np.array(js) % 8)).astype(np.uint8))
        out[y] = int.from_bytes(bits.tobytes(), "little")
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each start of b."""
    last = (1 << len(b)) - 1
    for last in _rows(a, _masks(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits)))


def common_places(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b, by bit-parallel rows of the table.

    Elements are keys, or tuples of keys that meet where they share one. Those that only one side has and a common start are set aside first: of two first elements that meet, some longest
    subsequence has the pair. A table of more than TABLE_BITS is halved at the place of b where both halves
    share most, so memory stays bounded; time is that of lengths times lengths over the bits of an integer. Of several such subsequences it takes
    the one whose elements come first in a.
    """
    a, b = ([x if isinstance(x, tuple) else (x,) for x in side] for side in (a, b))
    have, other = ({key for x in side for key in x} for side in (b, a))
    at = [i for i, v in enumerate(a) if not have.isdisjoint(v)]
    x, y = [a[i] for i in at], [v for v in b if not other.isdisjoint(v)]
    n = next((i for i, (v, w) in enumerate(zip(x, y)) if set(v).isdisjoint(w)), min(len(x), len(y)))
    x, y = x[n:], y[n:]
    if not x or not y:
        middle = []
    elif len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        h = len(x) // 2
        cut = int((_lengths(x[:h], y) + _lengths(x[h:][::-1], y[::-1])[::-1]).argmax())
        middle = common_places(x[:h], y[:cut]) + [h + i for i in common_places(x[h:], y[cut:])]
    else:
        table, middle, j = [*_rows(x, _masks(y), len(y))], [], len(y) - 1
        for i in range(len(x) - 1, -1, -1):
            # down to the last place of b that the row so far ends at
            while j >= 0 and table[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if i and not table[i - 1] >> j & 1:
                continue  # the row above has it too
            middle.append(i)
            j -= 1
        middle.reverse()
    return at[:n] + [at[n + i] for i in middle]


def is_copy(one: dict, two: dict) -> bool:
    """Whether of two pages' contents (hashes and sizes of their lines) seven tenths, in code points, are common lines in the same order."""
    a, b = (list(zip(p["hashes"], p["sizes"])) for p in (one, two))
    total = sum(n for _, n in a) + sum(n for _, n in b)
    if not total:
        return True
    other = {h for h, _ in b}
    if 2 * sum(n for h, n in a if h in other) < COPY * total:
        return False
    return 2 * sum(a[i][1] for i in common_places([h for h, _ in a], [h for h, _ in b])) >= COPY * total


def _copies(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array([bool(x and y and is_copy(x, y)) for x, y in zip(one.to_pylist(), two.to_pylist())], pa.bool_())


def keys_of(open_: dict) -> list[tuple[int, tuple]]:
    """The lines of a page that may be aligned, by place, with their keys."""
    return [(i, (("t", h),) if s is None else (("t", h), ("s", s))) for i, h, s in zip(open_["places"], open_["hashes"], open_["slots"])]


def shared_places(own: dict, path: str, around: list[dict | None]) -> list[int]:
    """Places of lines that the nearer of the neighbours (path, open; None: of another host) has too, by text or slot, or that stand in a slot of such a line."""
    near = [(x["path"] != path, len(os.path.commonprefix([x["path"], path])), -i, x["open"]) for i, x in enumerate(around) if x]
    if not near:
        return []
    mine, theirs, shared = keys_of(own), keys_of(max(near, key=lambda x: x[:3])[3]), set()
    rest = mine
    while found := common_places([k for _, k in rest], [k for _, k in theirs]):
        shared.update(rest[n][0] for n in found)
        slots = {keys[1] for i, keys in mine if i in shared and len(keys) == 2}
        shared.update(i for i, keys in mine if len(keys) == 2 and keys[1] in slots)
        # boilerplate that meets only in another order: each round takes a slot at least, so there are as many as these
        rest = [(i, keys) for i, keys in rest if i not in shared and len(keys) == 2]
    return sorted(shared)


def _shared(own: pa.Array, path: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.array([shared_places(o, p, around) for o, p, *around in zip(own.to_pylist(), path.to_pylist(), before.to_pylist(), after.to_pylist())], pa.list_(pa.int32()))


def _neighbours(nodes: DataFrame) -> DataFrame:
    """Adds before and after (host, path, open) to nodes (host, path, url, uid, content, open): the pages around each one's run of copies, of any host. Contents, of use for telling copies only, are left behind then."""
    order = ["host", "path", "url", "uid"]
    ordered = nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = saved(ordered, "ordered")  # partitions are numbered once
    one, key = F.struct("host", "path", "content", "open"), F.struct(*order)
    up, down = Window.partitionBy("part").orderBy(*order), Window.partitionBy("part").orderBy(*[F.desc(c) for c in order])
    parts = Window.orderBy("part")
    # a partition's first and last page have their neighbours in others: one row for each partition
    edges = ordered.groupBy("part").agg(F.max_by(one, key).alias("last"), F.min_by(one, key).alias("first"))
    edges = edges.select("part", F.lag("last").over(parts).alias("_before"), F.lead("first").over(parts).alias("_after"))
    rows = ordered.withColumns({"before": F.lag(one).over(up), "after": F.lead(one).over(up)}).join(edges, "part")
    rows = rows.withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")}).drop("_before", "_after")
    copy = lambda x: F.coalesce((F.col(f"{x}.host") == F.col("host")) & F.arrow_udf(_copies, "boolean")("content", f"{x}.content"), F.lit(False))
    # where a run begins its first page knows the page before, where it ends its last knows the page after
    at = lambda x: F.when(~copy(x), F.struct(F.when(F.col(x).isNotNull(), F.struct(F.col(x)["host"].alias("host"), F.col(x)["path"].alias("path"), F.col(x)["open"].alias("open"))).alias("at")))
    rows = saved(rows.withColumns({"before": at("before"), "after": at("after")}).drop("content"), "runs")
    known = F.last("before", True).over(up), F.last("after", True).over(down)
    # a run may begin or end in another partition: again one row for each
    ends = rows.groupBy("part").agg(F.max_by("before", F.when(F.col("before").isNotNull(), key)).alias("last"), F.min_by("after", F.when(F.col("after").isNotNull(), key)).alias("first"))
    ends = ends.select("part", F.last("last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("first", True).over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    rows = rows.withColumns({"before": known[0], "after": known[1]}).join(ends, "part")
    return rows.withColumns({"before": F.coalesce("before", "_before")["at"], "after": F.coalesce("after", "_after")["at"]}).drop("_before", "_after", "part")


def shared_lines(pages: DataFrame) -> DataFrame:
    """uid and the places of lines that the nearest page has too, of pages (uid, host, path, url, page); those that share nothing are left out.

    Pages of a host with equal lines are one node, at the least of their paths.
    """
    pages = pages.where("page.n > 0").dropDuplicates(["uid"]).withColumn("node", F.struct(F.xxhash64("page"), F.hash("page")))
    first = F.struct("path", "url", "uid")
    nodes = pages.groupBy("host", "node").agg(F.min(first).alias("first"), F.min_by("page", first).alias("page")).select("host", "node", "first.*", "page.content", "page.open")
    rows = _neighbours(nodes)
    near = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(F.col(f"{c}.path").alias("path"), F.col(f"{c}.open").alias("open")))
    found = rows.select("host", "node", F.arrow_udf(_shared, "array<int>")("open", "path", near("before"), near("after")).alias("places"))
    found = pages.select("uid", "host", "node").join(found.where("size(places) > 0"), ["host", "node"])
    return saved(found.select("uid", "places"), "shared")


def main_text(df: DataFrame, page: str = "html", url: str = "url", out: str = "text", keep: list[str] | None = None, aligned: bool = True) -> DataFrame:
    """Adds the main text, its blocks joined by two line ends, n_shared, how many of the page's lines the nearest page has too, by text or slot, and n_settled, how many others went by structure, to the columns in keep, or else all.

    Null and empty pages give empty texts. White space in a block becomes one space, character references are decoded. A null URL or one
    without a host has no neighbour; there structure settles all. Where all of a page's content would go, it stays. Repeated rows give repeated results and count once among neighbours. Very long pages are read in one pass. The
    columns that it adds replace columns of the same names. Without `aligned` lines that the neighbour has are left in, to tell what the alignment does.
    """
    small_batches(df.sparkSession, 500)
    keep = [c for c in (keep or df.columns) if c not in (out, "n_shared", "n_settled")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    uid = F.struct(F.xxhash64(url, page).alias("a"), F.hash(url, page).alias("b"))
    pages = df.select(uid.alias("uid"), host.alias("host"), path.alias("path"), F.col(url).alias("url"), F.arrow_udf(_lines, LINES)(F.col(page)).alias("page"))
    found = shared_lines(saved(pages.where("host <> ''"), "lines")).withColumnsRenamed({"uid": "_uid", "places": "_places"})
    rows = df.select(*keep, uid.alias("_uid"), F.arrow_udf(_packed, "binary")(F.col(page)).alias("_lines")).join(found.hint("merge"), "_uid", "left")
    rows = rows.select(*keep, left_udf(aligned)("_lines", "_places").alias("_left"), F.greatest(F.coalesce(F.size("_places"), F.lit(0)), F.lit(0)).cast("long").alias("n_shared"))
    return rows.select(*keep, F.col("_left.text").alias(out), "n_shared", F.col("_left.n_settled").alias("n_settled"))


by_value(__name__)
