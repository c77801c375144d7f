"""Tables from static page HTML: links, metadata, texts, controls, their ancestors, state styles.

One job parses each page once (``parse_pages``) to nested rows; the public functions select from
it. Only what static markup tells is there: no computed style, geometry or shadow DOM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.sources.selectors import StateRules

# Which elements are controls, prose, structure and landmarks.
CONTROL_TAGS = frozenset(("button", "a", "input", "select", "textarea"))
CONTROL_ROLES = frozenset(
    ("button", "option", "menuitem", "menuitemcheckbox", "menuitemradio", "tab", "checkbox", "radio", "switch", "combobox")
)
PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "dt", "dd"))
STRUCTURE = frozenset(("main", "nav", "header", "footer", "aside", "section", "article", "form", "dialog", "table", "ul", "ol"))
LANDMARKS = frozenset(("banner", "navigation", "main", "contentinfo", "complementary", "search", "form", "region"))
TRACKED = ("color", "background-color", "border-color", "box-shadow", "outline", "opacity")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Pages whose parsed rows are held at a time.
ROWS = 100

STRINGS = pa.list_(pa.string())
ANCESTOR = pa.struct([(x, pa.string()) for x in ("path", "tag", "role", "landmark", "id", "class")])
LINK = pa.struct([("href", pa.string()), ("text", pa.string())])
META = pa.struct([("name", pa.string()), ("content", pa.string())])
TEXT = pa.struct([("path", pa.string()), ("tag", pa.string()), ("text", pa.string())])
STYLE = pa.struct([(x, pa.string()) for x in ("path", "state", "property", "value")])
CONTROL = pa.struct(
    [(x, pa.string()) for x in ("path", "tag", "role", "text", "label", "placeholder", "name", "form", "input_type", "css_class", "href")]
    + [(x, pa.bool_()) for x in ("disabled", "required", "selected")]
    + [("ancestors", pa.list_(ANCESTOR))]
)
PARTS = {"links": LINK, "metadata": META, "texts": TEXT, "controls": CONTROL, "styles": STYLE}


class Element:
    """An element with what it inherits: the nearest form, label and structural element around it."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, place: int, text_from: int):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.place = self.last = place
        self.text_from = self.text_to = text_from
        self.own_text: list[str] = []
        self.tags: Counter[str] = Counter()
        self.nth = self.index = 0
        self.previous = self.newest = None
        self.known_path: str | None = None
        if parent:
            parent.tags[tag] += 1
            self.nth = parent.tags[tag]
            self.previous, parent.newest = parent.newest, self
            self.index = self.previous.index + 1 if self.previous else 1
            self.in_section = parent.in_section or parent.tag in ("article", "section")
            self.in_control = parent.in_control or parent.is_control()
            self.unread = parent.unread or tag in ("script", "style")
            self.form = parent if parent.tag == "form" else parent.form
            self.label = parent if parent.tag == "label" else parent.label
            self.structure = parent if parent.is_structure() else parent.structure
        else:
            self.in_section = self.in_control = self.unread = False
            self.form = self.label = self.structure = None

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def path(self) -> str:
        """CSS path from the root on; the page's ``html`` element isn't told."""
        if self.known_path is None:
            parts, x = [], self
            while x.parent and x.known_path is None and x.tag != "html":
                own = f"{x.tag}#{x.get('id')}" if x.get("id") else x.tag
                many = not x.get("id") and x.parent.tags[x.tag] > 1
                parts.append(f"{own}:nth-of-type({x.nth})" if many else own)
                x = x.parent
            if x.known_path:
                parts.append(x.known_path)
            self.known_path = " > ".join(reversed(parts))
        return self.known_path

    def is_control(self) -> bool:
        return self.tag in CONTROL_TAGS or self.get("role") in CONTROL_ROLES

    def is_structure(self) -> bool:
        return bool(self.parent) and (self.tag in STRUCTURE or landmark(self) != "")

    def structures(self) -> Iterator[Element]:
        """Structural elements around it, nearest first."""
        up = self.structure
        while up:
            yield up
            up = up.structure


class Tree(HTMLParser):
    """Elements in page order, each with the ranges of its descendants and of its texts."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.open: Counter[str] = Counter()
        self.at = self.root = Element("", {}, None, -1, 0)
        self.feed(html)
        self.close()
        while self.at is not self.root:
            self.leave()
        self.controls_before = [0, *accumulate(x.is_control() for x in self.elements)]

    def leave(self) -> None:
        x = self.at
        x.last, x.text_to = len(self.elements) - 1, len(self.texts)
        self.open[x.tag] -= 1
        self.at = x.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag == "p" and tag in BLOCKS or self.at.tag == tag == "li":
            self.leave()
        own = Element(tag, {k: v if v is not None else "" for k, v in attrs}, self.at, len(self.elements), len(self.texts))
        self.elements.append(own)
        if tag not in VOID:
            self.at = own
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.at.tag != tag:
                self.leave()
            self.leave()

    def handle_data(self, data: str) -> None:
        self.at.own_text.append(data)
        self.texts.append("" if self.at.unread else data)

    def text(self, x: Element) -> str:
        return " ".join("".join(self.texts[x.text_from : x.text_to]).split())

    def inside(self, x: Element) -> list[Element]:
        return self.elements[x.place + 1 : x.last + 1]

    def has_control(self, x: Element) -> bool:
        """Whether it is, holds or lies in a control."""
        return x.in_control or self.controls_before[x.last + 1] > self.controls_before[x.place]


def landmark(x: Element) -> str:
    if x.get("role") in LANDMARKS:
        return x.get("role")
    named = x.get("aria-label") or x.get("aria-labelledby")
    own = {"main": "main", "nav": "navigation", "aside": "complementary"}
    top = {"header": "banner", "footer": "contentinfo"}
    return own.get(x.tag) or ("" if x.in_section else top.get(x.tag, "")) or ("form" if x.tag == "form" and named else "")


def _labels(tree: Tree, x: Element, by_id: dict[str, Element], label_for: dict[str, Element]) -> tuple[str, str]:
    """(accessible name, label) of a control."""
    told = by_id.get(x.get("aria-labelledby"))
    inner = tree.inside(x)
    images = (y.get("alt") for y in inner if y.tag == "img")
    titles = (tree.text(y) for y in inner if y.tag == "title")
    by = tree.text(told) if told else ""
    chain = (tree.text(x), x.get("aria-label"), by, x.get("title"), *images, *titles)
    own = label_for.get(x.get("id")) if x.get("id") else None
    labels = (tree.text(own) if own else "", tree.text(x.label) if x.label else "", by)
    return next((y.strip() for y in chain if y.strip()), ""), next(filter(None, labels), "")


@lru_cache(maxsize=64)
def _state_rules(css: str) -> StateRules:
    """Pages of a site share their style sheets."""
    return StateRules(css, TRACKED)


def parse_page(html: str, parts: tuple[str, ...] = tuple(PARTS)) -> dict:
    """The nested tables of one page, or those of ``parts``."""
    tree = Tree(html)
    everything = tree.elements
    found: dict[str, list] = {}
    if "links" in parts:
        found["links"] = [{"href": x.get("href"), "text": tree.text(x)} for x in everything if x.tag == "a" and "href" in x.attributes]
    if "metadata" in parts:
        metas = [x for x in everything if x.tag == "meta"]
        found["metadata"] = [{"name": x.get("name") or x.get("property"), "content": x.get("content")} for x in metas if x.get("name") or x.get("property")]
    if "texts" in parts:
        found["texts"] = _texts(tree)
    if "controls" in parts:
        found["controls"] = _controls(tree)
    if "styles" in parts:
        rules = _state_rules("\n".join("".join(x.own_text) for x in everything if x.tag == "style"))
        states = [(x.path(), rules.of(x)) for x in everything if x.is_control()] if rules.rules else []
        found["styles"] = [{"path": p, "state": s, "property": k, "value": v} for p, told in states for (s, k), v in told.items()]
    return found


def _texts(tree: Tree) -> list[dict]:
    texts = []
    for x in tree.elements:
        if x.tag in PROSE and not tree.has_control(x):
            if own := " ".join(" ".join(x.own_text).split()):
                texts.append({"path": x.path(), "tag": x.tag, "text": own})
    return texts


def _controls(tree: Tree) -> list[dict]:
    everything = tree.elements
    by_id = {x.get("id"): x for x in reversed(everything) if x.get("id")}
    label_for = {x.get("for"): x for x in reversed(everything) if x.tag == "label" and x.get("for")}
    controls = [x for x in everything if x.is_control()]
    rows = []
    for x in controls:
        name, label = _labels(tree, x, by_id, label_for)
        chosen = x.get("aria-selected") == "true" or x.get("aria-checked") == "true" or x.get("data-state") in ("checked", "on")
        rows.append(
            {"path": x.path(), "tag": x.tag, "role": x.get("role"), "text": name, "label": label, "placeholder": x.get("placeholder"),
             "name": x.get("name"), "form": x.form.path() if x.form else "", "input_type": x.get("type"), "css_class": x.get("class"), "href": x.get("href"),
             "disabled": "disabled" in x.attributes, "required": "required" in x.attributes, "selected": chosen or "checked" in x.attributes,
             "ancestors": [{"path": y.path(), "tag": y.tag, "role": y.get("role"), "landmark": landmark(y), "id": y.get("id"), "class": y.get("class")} for y in x.structures()]}
        )
    return rows


def _parse(parts: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            pages = [parse_page(x.as_py() or "", parts) for x in batch["html"]]
            yield pa.record_batch({x: batch[x] for x in ("page_id", "url")} | {k: pa.array([x[k] for x in pages], pa.list_(PARTS[k])) for k in parts})

    return run


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"`{x.name}`:{_ddl(x.type)}" for x in kind) + ">"
    return "boolean" if pa.types.is_boolean(kind) else "string"


def parse_pages(pages: DataFrame, parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """(page_id, url, links, metadata, texts, controls, styles), each page parsed once; of these arrays only ``parts``
    are made."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    kinds = ", ".join(f"{k} array<{_ddl(PARTS[k])}>" for k in parts)
    return rows.mapInArrow(_parse(parts), f"page_id long, url string, {kinds}")


def _exploded(parsed: DataFrame, part: str) -> DataFrame:
    return parsed.select("page_id", "url", F.posexplode(part).alias("pos", "x")).select("page_id", "url", "pos", "x.*")


def extract_links(parsed: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text, scheme): every ``a[href]`` with its absolute address."""
    found = _exploded(parsed, "links").withColumn("href", urls.resolve_href(F.col("url"), F.col("href")))
    return found.filter("href is not null").withColumn("scheme", F.lower(F.substring_index("href", ":", 1)))


def extract_metadata(parsed: DataFrame) -> DataFrame:
    """(page_id, url, metadata): a map; of equal names the last one stays."""
    last = F.max_by("content", "pos").alias("content")
    flat = _exploded(parsed, "metadata").groupBy("page_id", "url", "name").agg(last)
    return flat.groupBy("page_id", "url").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("metadata"))


def extract_texts(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "texts")


def extract_description(parsed: DataFrame, length: int = 300) -> DataFrame:
    """The meta description, else the first h1 and the first paragraph of over 20 characters."""
    own = F.filter("metadata", lambda x: (F.lower(x["name"]) == "description") & (F.trim(x["content"]) != ""))
    first = lambda where: F.get(F.filter("texts", where), F.lit(0))["text"]
    made = F.concat_ws(" - ", first(lambda x: x["tag"] == "h1"), first(lambda x: (x["tag"] == "p") & (F.char_length(x["text"]) > 20)))
    return parsed.select("page_id", "url", F.substring(F.coalesce(F.get(own, F.lit(0))["content"], made), 1, length).alias("description"))


def extract_components(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "controls").drop("ancestors")


def extract_ancestors(parsed: DataFrame) -> DataFrame:
    """(page_id, url, component_path, distance, path, tag, role, landmark, ...), nearest first."""
    rows = _exploded(parsed, "controls").select("page_id", "url", F.col("path").alias("component_path"), F.posexplode("ancestors").alias("distance", "a"))
    return rows.select("page_id", "url", "component_path", (F.col("distance") + 1).alias("distance"), "a.*")


def extract_state_styles(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "styles").drop("pos")
