"""Main text of web pages by wrapper induction over pages of one host."""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, map_arrow, materialize, table

#: A text is of the template if this share of all pages with its place, and so many pages, have it there.
CONSTANT_SHARE, CONSTANT_PAGES = 0.6, 3
#: Outside of marked articles also if so many pages, and so many times those of the place's other texts on average, have it.
REPEATED = 10
#: Wrappers are broadcast up to so many bytes; beyond, they are joined by host. So are places and candidates.
BROADCAST_BYTES = 16 << 20

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|</?[a-zA-Z][^<]*\Z|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split())
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption dd dt li option summary".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
OUT = frozenset("head script style noscript template nav aside footer form button select option textarea iframe svg canvas object embed audio video map dialog menu title xmp noembed noframes".split())
#: Words in class or id names that mark what is beside the article.
BESIDE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice gdpr popup modal newsletter subscribe signup share sharing social related recommended comment comments reply replies disqus login search widget toolbar masthead copyright pagination pager legal".split())
#: Words that stand beside those in a name without changing its sense.
PLAIN = frozenset("area bar block bottom box btn button buttons col column container content desktop fixed float form global group header icon icons inline inner item items left link links list main mobile module outer page panel post right row section site small social sticky text toggle top ui view wrap wrapper".split())
MAIN_ROLES = frozenset(("main", "article", "articlebody"))


class Page:
    """Elements of a page (signature, parent, excluded, in an article or main region, in one or in a marked body) and its blocks of text in page order."""

    def __init__(self, source: str):
        self.sig: list[str] = ["#"]
        self.parent: list[int] = [-1]
        self.out: list[bool] = [False]
        self.main: list[bool] = [False]
        self.inside: list[bool] = [False]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, at: int, tag: str, attributes: str) -> int:
        names, role, hidden = [], "", False
        if attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                key = key.lower()
                if key in ("class", "id"):
                    names.append(value)
                elif key in ("role", "itemprop"):
                    role = value.lower()
                elif key == "hidden" or value.lower() == "true":
                    hidden = True
        main = tag in ("article", "main") or role in MAIN_ROLES
        marked = [{p.lower() for p in PART.findall(name)} for n in names for name in n.split()] if tag not in ("html", "body") else []
        # a name marks what is beside the article if all of its words do, but for plain ones: login-box, not login-guide
        beside = any(words & BESIDE and words <= BESIDE | PLAIN for words in marked)
        out = self.out[at] or tag in OUT or hidden or beside or role in ("navigation", "banner", "contentinfo", "complementary", "search")
        if not self.inside[at] and not main and (tag == "header" or any("header" in words and words <= BESIDE | PLAIN for words in marked)):
            out = True
        self.sig.append(tag + ("." + names[0].split()[0] if names and names[0].split() else ""))
        self.parent.append(at)
        self.out.append(out)
        # the body of an article is not all of it: title and lead may stand before the body
        self.main.append(tag in ("article", "main") or role in ("main", "article") or self.main[at])
        self.inside.append(main or self.inside[at])
        return len(self.sig) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#", 0, True)]
        text: list[str] = []
        silent: set[int] = set()  # excluded elements inside a block's text

        def flush() -> None:
            if text:
                block = SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if block:
                    at = next(i for t, i, b in reversed(stack) if b)
                    self.blocks.append((at, block))
                text.clear()

        raw = ""
        for m in TOKEN.finditer(source):
            token = m.group()
            tag = m.group(2)
            if raw:
                if not (tag and m.group(1) and tag.lower() == raw):
                    continue
                raw = ""
            if tag is None:
                if stack[-1][1] in silent:
                    continue
                if token[0] != "<" or token == "<":
                    text.append(token)
                elif token.startswith("<![CDATA["):
                    text.append(token[9:-3])
                continue
            tag = tag.lower()
            block = tag in BLOCK
            if m.group(1):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                if block:
                    flush()
                if k and (block or not any(b for _, _, b in stack[k + 1 :])):
                    del stack[k:]
                continue
            if block:
                flush()
                if tag in CLOSES_P:
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
                    if k:
                        del stack[k:]
                elif tag in SAME:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                        if stack[k][0] in SAME[tag]:
                            break
            elif tag == "br":
                text.append(" ")
            if tag in VOID:
                continue
            at = stack[-1][1]
            own = block or tag in OUT
            if own:
                at = self._open(at, tag, m.group(3))
                if not block:
                    silent.add(at)
                    own = False
            elif m.group(3) and ("class" in m.group(3) or "id" in m.group(3)):
                inner = self._open(at, tag, m.group(3))
                if self.out[inner] and not self.out[at]:
                    at = inner
                    silent.add(at)
                else:
                    for x in (self.sig, self.parent, self.out, self.main, self.inside):
                        x.pop()
            if tag in RAW:
                raw = tag
                continue
            stack.append((tag, at, own))
        flush()


Skeleton = tuple  # (signature, places of its own blocks' elements, children)


def skeleton(page: Page) -> tuple[Skeleton, list[int]]:
    """The tree of elements with equal neighbouring leaves as one, and each element's node number, in document order."""
    kids: list[list[int]] = [[] for _ in page.sig]
    for i, p in enumerate(page.parent[1:], 1):
        kids[p].append(i)
    node = [0] * len(page.sig)
    count = 0

    def build(i: int) -> tuple:
        nonlocal count
        node[i] = count
        count += 1
        children: list[tuple] = []
        last = ""
        for k in kids[i]:
            if not kids[k] and page.sig[k] == last:
                node[k] = count - 1
                continue
            children.append(build(k))
            last = page.sig[k] if not kids[k] else ""
        return (page.sig[i], tuple(children))

    limit = 400
    depth = [0] * len(page.sig)
    for i, p in enumerate(page.parent[1:], 1):
        depth[i] = depth[p] + 1
        if depth[i] > limit:  # deeper elements hang on the last allowed level
            kids[p].remove(i)
            page.parent[i] = page.parent[p]
            kids[page.parent[i]].append(i)
            depth[i] = limit
    return build(0), node


def _size(tree: tuple) -> int:
    return 1 + sum(map(_size, tree[1]))


def tree_match(a: tuple, b: tuple) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving match of two trees with equal roots; node numbers of a to those of b."""
    sizes: dict[int, int] = {}

    def size(t: tuple) -> int:
        if id(t) not in sizes:
            sizes[id(t)] = 1 + sum(size(c) for c in t[1])
        return sizes[id(t)]

    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: tuple, y: tuple) -> tuple[int, list]:
        if x[0] != y[0]:
            return 0, []
        key = (id(x), id(y))
        if key in memo:
            return memo[key]
        n, m = len(x[1]), len(y[1])
        if x == y:
            memo[key] = size(x), [(i, i) for i in range(n)]
            return memo[key]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                w = match(x[1][i], y[1][j])[0]
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
        pairs, i, j = [], n, m
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[key] = (1 + best[n][m], pairs[::-1])
        return memo[key]

    found: dict[int, int] = {}

    def trace(x: tuple, y: tuple, i: int, j: int) -> None:
        found[i] = j
        pairs = match(x, y)[1]
        firsts, seconds = [i + 1], [j + 1]
        for c in x[1]:
            firsts.append(firsts[-1] + size(c))
        for c in y[1]:
            seconds.append(seconds[-1] + size(c))
        for p, q in pairs:
            trace(x[1][p], y[1][q], firsts[p], seconds[q])

    if match(a, b)[0]:
        trace(a, b, 0, 0)
    return found


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 11  # fits a JSON number


def outline(source: str) -> tuple[str, int, list[int], list[int], list[int]]:
    """What induction needs of a page: its skeleton as JSON, a hash of all its texts, and of each block that
    isn't marked as beside the article twice its node (one more in a marked main region), mark and length."""
    page = Page(source)
    tree, node = skeleton(page)
    marks = [_mark(text) for _, text in page.blocks]
    kept = [(2 * node[at] + page.inside[at], m, len(text)) for (at, text), m in zip(page.blocks, marks) if not page.out[at]]
    key = _mark(",".join(map(str, sorted(marks))))
    return json.dumps(tree, separators=(",", ":")), key, *([list(x) for x in zip(*kept)] or [[], [], []])


def _tree(x) -> tuple:
    return (x[0], tuple(_tree(c) for c in x[1]))


def places(reference: tuple, tree: tuple) -> list[int]:
    """The place of each node of a tree: the node of the reference that it matches, or else the path to it from the place of its parent."""
    matched = {j: i for i, j in tree_match(reference, tree).items()}
    out: list[int] = []

    def walk(t: tuple, above: int) -> None:
        at = len(out)
        out.append(_mark(str(matched[at]) if at in matched else f"{above}/{t[0]}"))
        here = out[at]
        for c in t[1]:
            walk(c, here)

    walk(tree, 0)
    return out


class Wrapper:
    """A reference tree and, by place, the texts that are template there."""

    def __init__(self, text: str):
        tree, constant = json.loads(text)
        self.tree = _tree(tree)
        self.constant: dict[int, set] = {}
        for place, mark in constant:
            self.constant.setdefault(place, set()).add(mark)
        self.aligned: dict[tuple, list[int]] = {}

    def templates(self, tree: tuple) -> list[int]:
        """The places of a page's nodes."""
        if tree not in self.aligned:
            if len(self.aligned) > 64:
                self.aligned.clear()
            self.aligned[tree] = places(self.tree, tree)
        return self.aligned[tree]


def extract(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text, joined in page order by a blank line: blocks of the article and main regions, of the page where
    none is marked. Only template and marked surroundings are left out."""
    if not source:
        return ""
    page = Page(source)
    blocks = [b for b in page.blocks if not page.out[b[0]]]
    if wrapper and wrapper.constant:
        tree, node = skeleton(page)
        place = wrapper.templates(tree)
        blocks = [b for b in blocks if _mark(b[1]) not in wrapper.constant.get(2 * place[node[b[0]]] + page.inside[b[0]], ())]
    # all marked regions that hold text, or else the whole page
    main = [text for at, text in blocks if page.main[at]]
    return "\n\n".join(main or [text for _, text in blocks])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], bytes_: Column, how: str = "inner") -> DataFrame:
    """A join that doesn't move left while right, written before, is small."""
    total = right.agg(F.coalesce(F.sum(bytes_), F.lit(0)).alias("n")).first()["n"]
    return left.join(F.broadcast(right) if total <= BROADCAST_BYTES else right, keys, how)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of the hosts with template texts, from all pages (host, html).

    Pages with the same blocks count once, for copies of an article say nothing on the template. Each
    skeleton of a host is aligned once with the host's most frequent one; nodes without a match there keep
    places of their own, so that no layout is left out. Texts are counted by place over all pages.
    """
    traced_as = "host string, key long, shape long, tree string, nodes array<long>, marks array<long>, sizes array<int>"

    def outlines(batch: pa.RecordBatch):
        seen, found = set(), []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree, key, *blocks = outline(source)
            shape = _mark(tree)
            found.append((host, key, shape, None if (host, shape) in seen else tree, *blocks))
            seen.add((host, shape))
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield _batch(found, types, ["host", "key", "shape", "tree", "nodes", "marks", "sizes"])

    def align(batch: pa.RecordBatch):
        found = [(h, s, places(_tree(json.loads(r)), _tree(json.loads(t)))) for h, s, t, r in zip(*(c.to_pylist() for c in batch.columns))]
        yield _batch(found, [pa.string(), pa.int64(), pa.list_(pa.int64())], ["host", "shape", "places"])

    def placed(batch: pa.RecordBatch):
        for host, nodes, marks, sizes, place, *more in zip(*(c.to_pylist() for c in batch.columns)):
            yield host, [(2 * place[n >> 1] + (n & 1), m) for n, m in zip(nodes, marks)], sizes, *more

    def counted(counts: dict):
        rows = [(*k, n) for k, n in counts.items()]
        return _batch(rows, [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["host", "place", "mark", "n"])

    def tally(batch: pa.RecordBatch):
        counts: dict[tuple, int] = {}
        for host, items, _ in placed(batch):
            for x in set(items):
                counts[(host, *x)] = counts.get((host, *x), 0) + 1
        yield counted(counts)

    def evidence(batch: pa.RecordBatch):
        # pages that are candidates for the most part are near copies of each other
        counts: dict[tuple, int] = {}
        known: dict[str, dict] = {}
        for host, items, sizes, candidates in placed(batch):
            if host not in known:
                known[host] = {(c["place"], c["mark"]): c["fixed"] for c in candidates}
            of = known[host]
            rest = sum(n for x, n in zip(items, sizes) if not of.get(x))
            if 2 * sum(n for x, n in zip(items, sizes) if of.get(x) is False) <= rest:
                for x in {x for x in items if of.get(x) is False}:
                    counts[(host, *x)] = counts.get((host, *x), 0) + 1
        yield counted(counts)

    traced = materialize(map_arrow(pages, outlines, traced_as), "outlines")
    once = traced.groupBy("host", "key").agg(F.min(F.struct("shape", "nodes", "marks", "sizes")).alias("p")).select("host", "p.*")
    once = materialize(once, "once")
    shapes = traced.filter("tree is not null").groupBy("host", "shape").agg(F.min("tree").alias("tree"))
    shapes = materialize(shapes.join(once.groupBy("host", "shape").agg(F.count("*").alias("pages")), ["host", "shape"]), "shapes")
    most = F.max(F.struct("pages", F.length("tree").alias("size"), "tree"))["tree"]
    reference = materialize(shapes.groupBy("host").agg(most.alias("reference"), F.sum("pages").alias("n")).filter(F.col("n") >= CONSTANT_PAGES).drop("n"), "references")
    both = _joined(shapes.select("host", "shape", "tree"), reference, ["host"], F.octet_length("reference")).select("host", "shape", "tree", "reference")
    slots = materialize(map_arrow(both, align, "host string, shape long, places array<long>"), "places")
    spots = _joined(once, slots, ["host", "shape"], 8 * F.size("places") + 40).select("host", "nodes", "marks", "sizes", "places")

    counts_as = "host string, place long, mark long, n long"
    counts = materialize(map_arrow(spots, tally, counts_as).groupBy("host", "place", "mark").agg(F.sum("n").alias("n")), "counts")
    present = shapes.select("host", "shape", "pages").join(slots, ["host", "shape"]).select("host", "pages", F.explode(F.array_distinct("places")).alias("node"))
    present = present.groupBy("host", "node").agg(F.sum("pages").alias("pages"))
    variety = counts.groupBy("host", "place").agg(F.sum("n").alias("total"), F.count("*").alias("texts"))
    often = counts.filter(F.col("n") >= CONSTANT_PAGES).join(variety, ["host", "place"]).withColumn("node", F.shiftright("place", 1)).join(present, ["host", "node"])
    n = F.col("n")
    rare = (F.col("place") % 2 == 0) & (n >= REPEATED) & (n * (F.col("texts") - 1) >= REPEATED * (F.col("total") - n))
    often = often.withColumn("fixed", n >= CONSTANT_SHARE * F.col("pages")).filter(F.col("fixed") | rare)
    often = materialize(often.select("host", "place", "mark", "fixed", "total", "texts"), "often")
    sets = materialize(often.groupBy("host").agg(F.collect_list(F.struct("place", "mark", "fixed")).alias("candidates"), F.bool_and("fixed").alias("all")).filter("not all").drop("all"), "candidates")
    seen = _joined(spots, sets, ["host"], 24 * F.size("candidates") + 40).select("host", "nodes", "marks", "sizes", "places", "candidates")
    seen = map_arrow(seen, evidence, counts_as).groupBy("host", "place", "mark").agg(F.sum("n").alias("n"))
    template = often.filter("fixed").select("host", "place", "mark").union(often.filter("not fixed").join(seen, ["host", "place", "mark"]).filter(rare).select("host", "place", "mark"))
    texts = template.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.array("place", "mark")))).alias("constant"))
    found = texts.join(reference, "host").select("host", F.concat(F.lit("["), "reference", F.lit(","), "constant", F.lit("]")).alias("wrapper"))
    found = materialize(found, "wrappers")
    discard(traced, once, shapes, reference, slots, counts, often, sets)
    return found


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. A null html has an empty text; a null url is a host of its own kind.

    Outlines of all pages of a host induce its wrapper. The pages themselves are not moved while all
    wrappers together are small; else they are joined by host.
    """
    spark = pages.sparkSession
    bound_batches(spark, 1000)
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    found = wrappers(rows.filter("host <> '' and html is not null").select("host", "html"))
    joined = _joined(rows, found, ["host"], F.octet_length("wrapper") + F.octet_length("host"), "left")

    def run(batch: pa.RecordBatch):
        known: dict[str, Wrapper] = {}
        texts = []
        for source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if wrapper is not None and wrapper not in known:
                known[wrapper] = Wrapper(wrapper)
            texts.append(extract(source, known.get(wrapper)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(joined.select("page_id", "url", "html", "wrapper"), run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
