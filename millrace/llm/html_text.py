"""Operator 7, main text of web pages by template deduction from equivalence classes.

A page is read as tokens: each opening tag with its path of open elements, and each run of text
with its path. For every host, a token's occurrence vector (how often it occurs on each page) is
kept as a fingerprint, a sum that pages and repeated rows add to in any order, so a host of any
size is summed up in parallel. Tokens of a host that share their occurrence vector are an
equivalence class. A class is valid if it has support: enough pages of different content have it
(hosts of fewer pages have no template, and each of their pages is read by itself), and tags are
among it. Pages whose longest runs (half of the main text) are the same have one content, so that
copies of an article make no template, whatever tags they hold.

The tags of valid classes, nested by their paths and in the order of their mean place, are the
host's template. A page fits it if the tags that its own classes have once a page come in that
order. What stands in an element of the template is a slot; a slot's text is template text if it
shares the vector of tags (the words of a bar, a notice, a button), and a slot is a menu if on all
pages of the host nine tenths of its text or more is in links.

Main text is what the template leaves open: the slots inside <article> or <main> where a page has
them, else those that are no menus inside the common ancestor of what holds text outside links.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments, told by element,
role, class or id, are left out, but an <article> or <main> inside of one is not if the page has no
other; scripts and styles always are.
"""

from __future__ import annotations

import html as _html
import re
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import parts, table, written

#: Element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
REGIONS = frozenset("nav header footer aside form menu dialog".split())
LEFT_OUT = frozenset("head button select datalist script style textarea title noscript iframe xmp noframes template svg math canvas object audio video".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("html body article main section div nav header footer aside form ul ol dl table td th blockquote button".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon copyright sidebar widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login search searchform comment comments commentlist respond reply replies disqus share sharing social related recommended pagination pager toolbar skip contentinfo complementary".split()
)
#: Words that names of such regions have besides: "site-header" is one, "share-price" and "has-sidebar" aren't.
STRUCTURE = frozenset("area bar block body bottom box button buttons col column container content form global group header icon icons inner item items left link links list main outer page panel post primary reader right section secondary site slot text title top user wrap wrapper".split())
_NUMBER = re.compile(r"\d+")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class _Element:
    __slots__ = ("base", "hints", "link", "name", "out", "path")

    def __init__(self, name: str, path: str, out: bool, base: int | None, hints: int, link: bool):
        self.name, self.path, self.out, self.base, self.hints, self.link = name, path, out, base, hints, link


def _hint(mark: str) -> bool:
    """Whether a class, id or role names boilerplate: one of its names has such a word, and no word of another kind."""
    return any(not BOILERPLATE.isdisjoint(w) and w <= BOILERPLATE | STRUCTURE for w in (set(re.split(r"[^a-z]+", x)) - {""} for x in mark.split()))


def parse(source: str) -> tuple[list[str], list[tuple[str, str, int, bool, int | None, int, bool]]]:
    """Paths of opening tags, and runs of text: container path, text, block, left out, base, hints, inside a link.

    hints: how many elements around it look like boilerplate; base: how many of these are around the
    outermost <article> or <main>, None outside of one. Numbers in classes and ids don't tell paths apart.
    """
    tags: list[str] = []
    runs: list[tuple[str, str, int, bool, int | None, int, bool]] = []
    stack = [_Element("", "", False, None, 0, False)]
    block = at = 0

    def text(chunk: str) -> None:
        if chunk and not chunk.isspace():
            top = stack[-1]
            box = next(e for e in reversed(stack) if e.name not in INLINE and e.name != "p")
            runs.append((box.path, _html.unescape(chunk) if "&" in chunk else chunk, block, top.out, top.base, top.hints, top.link))

    def close_to(k: int) -> None:
        nonlocal block
        if any(e.name not in INLINE for e in stack[k:]):
            block += 1
        del stack[k:]

    def close_open(names, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return close_to(k)
            if stack[k].name in stop:
                return None

    while m := _TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" or name not in VOID:
                close_open((name,), () if name in SCOPE else SCOPE)
            continue
        if name == "br":
            block += 1
            tags.append(f"{stack[-1].path}/br")
            continue
        if name in ENDS_P:
            close_open(("p",), SCOPE)
        elif name in ENDS_LIKE:
            close_open(ENDS_LIKE[name], ("ul", "ol", "dl", "table"))
        if name not in INLINE:
            block += 1
        marks = [(x or y or z).lower() for _, x, y, z in _ATTR.findall(m[3])] if "=" in m[3] else []
        top = stack[-1]
        label = name + "".join("." + _NUMBER.sub("#", s).replace("/", "_") for s in marks)
        path = f"{top.path}/{label}"
        tags.append(path)
        if name in VOID or m[3].endswith("/") and name not in ENDS_P:
            continue
        main = name in MAIN or "main" in marks
        hinted = name in REGIONS or name not in ("html", "body") and not main and any(map(_hint, marks))
        base = top.hints if top.base is None and main else top.base
        stack.append(_Element(name, path, top.out or name in LEFT_OUT, base, top.hints + hinted, top.link or name == "a"))
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            close_to(len(stack) - 1)
    text(source[at:])
    return tags, runs


def _tidy(s: str) -> str:
    return " ".join(s.split())


def host_of(url: str = "url"):
    """The host of a URL column in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit("")))


def _hash(s: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_tokens(source: str) -> tuple[dict[str, list[int]], list]:
    """Token to [count, first place, characters outside links, characters in links], and the runs. Text tokens have no more than the count.

    Characters are those of the slots that could be main text, for the innermost block that holds them.
    """
    tags, runs = parse(source)
    tokens: dict[str, list[int]] = {}
    for k, t in enumerate(tags):
        tokens.setdefault(f"<{t}", [0, k, 0, 0])[0] += 1
    for r in runs:
        tokens.setdefault(f"{r[0]}|{_tidy(r[1])}", [0, 0, 0, 0])[0] += 1
        if (at := tokens.get(f"<{r[0]}")) and not r[3]:
            at[3 if r[6] else 2] += len(r[1])
    return tokens, runs


class Template:
    """A host's template: tags (path, vector, pages, total, mean place, characters outside and in links) and hashes of its texts."""

    def __init__(self, tags: list[tuple], fixed):
        self.fixed, self.menus, self.children = frozenset(fixed), set(), {}
        order = sorted(tags, key=lambda t: (t[4], t[0]))
        self.paths = {t[0] for t in order}
        self.place: dict[str, tuple[int, int]] = {}  # of tags that pages have once: class and place in it
        classes: dict[tuple, list[str]] = {}
        for path, vector, pages, total, _, plain, linked in order:
            self.children.setdefault(self.around(path), []).append(path)  # nested by span
            if linked and linked >= 9 * plain:
                self.menus.add(path)
            if pages == total:
                members = classes.setdefault((vector, pages), [])
                self.place[path] = (len(classes), len(members))
                members.append(path)

    def fits(self, tags: list[str]) -> bool:
        """Whether the classes' tags come in the template's order."""
        last: dict[int, int] = {}
        for t in tags:
            if t in self.place:
                of, k = self.place[t]
                if last.get(of, -1) > k:
                    return False
                last[of] = k
        return True

    def slot(self, path: str) -> str:
        """The innermost element of the template at or around a path, empty if there is none."""
        while path and path not in self.paths:
            path = path.rsplit("/", 1)[0]
        return path

    def around(self, path: str) -> str:
        return self.slot(path.rsplit("/", 1)[0])

    def is_menu(self, path: str) -> bool:
        """Whether a run at this path stands in a menu: the slot, or one around it."""
        slot = self.slot(path)
        while slot and slot not in self.menus:
            slot = self.around(slot)
        return bool(slot)

    def is_text(self, run: tuple) -> bool:
        return _hash(f"{run[0]}|{_tidy(run[1])}") in self.fixed


NONE = Template([], ())


def slots(runs: list, template: Template = NONE) -> list:
    """The runs of a page's main text: what the template leaves open.

    Those of its <article> or <main>, of the ones with fewest boilerplate regions around them; on a
    page without one, all but menus inside the common ancestor of what holds text outside links.
    """
    inside = [r for r in runs if not r[3] and r[4] is not None and r[5] == r[4]]
    if inside:
        least = min(r[4] for r in inside)
        kept = [r for r in inside if r[4] == least]
    else:
        kept = [r for r in runs if not r[3] and not r[5]]
        if template.menus:
            kept = [r for r in kept if not template.is_menu(r[0])] or kept
    if template.fixed:
        kept = [r for r in kept if not template.is_text(r)]
    if inside:
        return kept
    boxes = {r[0] for r in kept if not r[6]}
    if not boxes:
        return kept
    box = commonprefix([b.split("/") for b in boxes])
    return [r for r in kept if r[0].split("/")[: len(box)] == box]


def main_text(source: str, template: Template = NONE) -> str:
    tags, runs = parse(source)
    blocks: list[str] = []
    last = None
    for _, text, block, *_ in slots(runs, template if template.fits(tags) else NONE):
        if block == last:
            blocks[-1] += text
        else:
            blocks.append(text)
        last = block
    return "\n".join(t for t in map(_tidy, blocks) if t)


def content_bits(runs: list) -> tuple[int, int]:
    """One bit of 128 by what a page is about: the longest runs that hold half of its main text. Copies of an article share it."""
    texts = sorted({_tidy(r[1]) for r in slots(runs)}, key=lambda t: (-len(t), t))
    half, held, longest = sum(map(len, texts)) / 2, 0, []
    for t in texts:
        if held >= half:
            break
        held += len(t)
        longest.append(t)
    bit = _hash("\n".join(longest)) % 128
    one = 1 << bit % 64
    one -= (one >> 63) << 64
    return (one, 0) if bit < 64 else (0, one)


def templates(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """host, tags (of valid classes), fixed (hashes of template texts), n_pages of hosts that have a template.

    pages: page_id, url, html. min_pages: support, pages of different content that a class needs.
    Rows that repeat count as often in every vector, so they change no class.
    """

    def tokens(batches):
        import pyarrow as pa

        names = ["host", "token", "path", "n", "place", "plain", "linked", "v1", "v2", "low", "high"]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 8]
        for batch in batches:
            rows = []
            for page_id, url, host, source in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "host", "html"))):
                found, runs = page_tokens(source or "")
                bits = content_bits(runs)
                for t, (n, place, plain, linked) in found.items():
                    vector = _hash(f"{page_id} {n} {url}") + (1 << 63)
                    rows.append((host, _hash(t), t[1:] if t[0] == "<" else None, n, place, plain, linked, vector >> 32, vector & 0xFFFFFFFF, *bits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "host string, token long, path string, n long, place long, plain long, linked long, v1 long, v2 long, low long, high long"
    rows = pages.select("page_id", "url", host_of().alias("host"), "html").mapInArrow(tokens, schema)
    sums = [F.sum(c).alias(c) for c in ("place", "plain", "linked", "v1", "v2")]
    seen = rows.groupBy("host", "token", "path").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), *sums)
    # two of five contents may share a bit, so one less is asked for
    seen = seen.where((F.col("pages") >= min_pages) & (F.bit_count("low") + F.bit_count("high") >= min_pages - 1))
    vector = F.concat_ws(" ", "v1", "v2")
    tag = F.when(F.col("path").isNotNull(), F.struct("path", vector.alias("vector"), "pages", "total", (F.col("place") / F.col("pages")).alias("place"), "plain", "linked"))
    classes = seen.groupBy("host", "v1", "v2", "pages", "total").agg(F.collect_list(tag).alias("tags"), F.collect_set(F.when(F.col("path").isNull(), F.col("token"))).alias("texts"))
    valid = classes.where("size(tags) > 0").groupBy("host")
    return valid.agg(F.flatten(F.collect_list("tags")).alias("tags"), F.array_distinct(F.flatten(F.collect_list("texts"))).alias("fixed"), F.max("pages").alias("n_pages"))


def extract(pages: DataFrame, min_pages: int = 5, most_broadcast: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html gives an empty text; null and repeated ids and urls are kept, and repeated
    rows give what single ones give; an empty table gives no rows (pages whose url has no host share
    one template); other columns are left alone. The templates, one row a host, are broadcast while
    they hold at most most_broadcast tags and texts; beyond that, those of the hosts with most pages
    are (an eighth of a task's rows or more, so eight a task at most), and only the others are joined.
    """
    spark = pages.sparkSession
    rules = written(templates(pages, min_pages), "templates")
    size = rules.agg(F.sum(F.size("tags") + F.size("fixed"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    if size <= most_broadcast:
        met = rows.join(F.broadcast(rules.drop("n_pages")), "host", "left")
    else:
        big = F.col("n_pages") > pages.count() // (8 * parts(spark))
        marked = rows.join(F.broadcast(rules.where(big).drop("n_pages")), "host", "left")
        rest = marked.where("tags is null").drop("tags", "fixed").join(rules.where(~big).drop("n_pages"), "host", "left")
        met = marked.where("tags is not null").unionByName(rest)

    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            texts = []
            hosts = batch["host"].to_pylist()
            for k, (source, h) in enumerate(zip(batch["html"].to_pylist(), hosts)):
                if h not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[h] = Template([tuple(t.values()) for t in batch["tags"][k].as_py() or ()], batch["fixed"][k].as_py() or ())
                texts.append(main_text(source, known[h]) if source else "")
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "host", "tags", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
