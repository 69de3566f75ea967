"""Main text of web pages by wrappers inferred from the pages of a host.

A page becomes a stream of structure tags and text slots. Neighbouring repeats
are folded into groups, which leaves few distinct forms in a host; they are counted before they meet. The
forms of a host are aligned one after the other with its wrapper, a regular expression
without alternatives: what only one side has becomes an optional group, one
copy of a unit against many a repeated group. Many forms of one host give partial wrappers in tasks of their own, which are then aligned with
each other. Texts that many different pages of a host share are constants unless other text is aligned with them; all other texts are slots.

Every page is then parsed against the expression of its host, which says for each of its texts which constant or slot it
fills, and whether in a repeated group. Element names and class words tell the article, menus, adverts and the like. Slots inside the page's own article, if it has
one, and outside the parts set apart are content. On pages without an article the places that the parse found decide:
a text that fills a constant is template, unless it stands in a repeated group, a table or a list with texts of the page's own.
"""

from __future__ import annotations

import difflib
import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import store, workspace

# Element names and class words with a meaning of their own.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "button")
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins kbd label mark
nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
NO_END = frozenset("area base col embed hr link meta param source track img input br wbr".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
LISTS = frozenset("table ul ol dl".split())
ASIDE = frozenset("nav header footer aside form menu dialog head".split())
MAIN = frozenset("article main".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related
replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
# Parts of a class name that speak of another block or of a state, and elements that class words never set apart.
STATES = frozenset("has have no not non with without is layout enabled disabled".split())
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
# Name by name with its value, so that values are never read as names.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]\S*)))?""")
SLOT = "#"
#: Forms or partial wrappers of one host that a task merges, about.
FAN = 64
#: Parses that a matcher keeps for pages with the same tokens.
KEEP = 4_096
#: A text is a candidate for the template if it stands on this many different pages of a host at least, and on this share of them.
COMMON_PAGES, COMMON_SHARE = 3, 0.5


def _names_a_part(value: str) -> bool:
    """Whether one of the names in a class or id value is that of a part set apart: a word of ``WORDS`` first or last, nothing from ``STATES``."""
    for name in value.split():
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if parts and not STATES.intersection(parts) and (parts[0] in WORDS or parts[-1] in WORDS):
            return True
    return False


def _key(name: str, attributes: str) -> str:
    """An element's name, with a mark if its attributes make it no part of the main text. The first of equal attributes counts."""
    if not attributes.strip():
        return name
    seen = set()
    for m in _ATTR.finditer(attributes):
        attribute = m[1].lower()
        if attribute in seen:
            continue
        seen.add(attribute)
        value = html_lib.unescape(next((v for v in m.groups()[1:] if v is not None), "")).strip()
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
            return name + "!"
        if attribute == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value, re.I):
            return name + "!"
        if attribute == "role" and value.lower() in ROLES:
            return name + "!"
        if attribute in ("class", "id") and name not in WHOLE and _names_a_part(value):
            return name + "!"
    return name


def stream(page: str) -> tuple[list[str], list[str]]:
    """Tokens of a page and the text of each slot. Inline tags part no text; ends of loose elements are left out."""
    tokens, texts, piece = [], [], []
    at = 0

    def flush():
        if piece:
            text = " ".join(html_lib.unescape("".join(piece)).split())
            piece.clear()
            if text:
                tokens.append(SLOT)
                texts.append(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            piece.append(page[at:])
            break
        piece.append(page[at: m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                piece.append(html_lib.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
            continue
        name, end, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not end and not attributes.endswith("/"):
                close = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page) if name in ("script", "style", "textarea", "title", "template") else at
            continue
        if name in INLINE:
            if name in ("br", "img", "input"):
                piece.append(" ")
            continue
        flush()
        if end:
            if name not in LOOSE and name not in NO_END:
                tokens.append("/" + name)
        else:
            tokens.append(_key(name, attributes))
    flush()
    return tokens, texts


def digest(text: str) -> int:
    """A signed number of 64 bits for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def marked(tokens: list[str], texts: list[str], common: frozenset) -> list[str]:
    """The tokens with the digest in the slot of each text that is common on the host."""
    if not common:
        return tokens
    digests = map(digest, texts)
    return [f"{SLOT}{d}" if t == SLOT and (d := next(digests)) in common else t for t in tokens]


def _distances(items: list) -> list[int]:
    """The distances between neighbouring equal items, in ascending order: the unit lengths worth a try."""
    last, out = {}, set()
    for i, x in enumerate(items):
        key = x if isinstance(x, str) else json.dumps(x)
        if key in last:
            out.add(i - last[key])
        last[key] = i
    return sorted(out)


def fold(items: list) -> list:
    """Neighbouring copies of a unit, shortest units first, become one repeated group ("+", unit). Units may have any length."""
    size = 0
    while size := next((d for d in _distances(items) if d > size), 0):
        out, i = [], 0
        while i < len(items):
            n, unit = 1, items[i: i + size]
            if i + size < len(items) and items[i] == items[i + size]:
                while items[i + n * size: i + (n + 1) * size] == unit:
                    n += 1
            if n > 1:
                group = ["+", unit[0][1] if size == 1 and unit[0][0] == "+" else unit]
                if not (out and out[-1] == group):
                    out.append(group)
                i += n * size
            elif out and isinstance(out[-1], list) and out[-1][1] == unit and len(unit) == size:
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _bare(x):
    """An item without the mark that it is optional."""
    return x[1][0] if isinstance(x, list) and x[0] == "?" else x


def _optional(x) -> bool:
    return isinstance(x, list) and x[0] == "?"


def _texts(x, y) -> bool:
    """Whether both are texts, perhaps optional."""
    x, y = _bare(x), _bare(y)
    return isinstance(x, str) and isinstance(y, str) and x.startswith(SLOT) and y.startswith(SLOT)


def merge(wrapper: list, form: list) -> list:
    """The wrapper that fits all that either side fits: a folded form or another wrapper beside it. An optional group ("?", [item]) has one item."""
    a, b = ([json.dumps(_bare(x)) for x in side] for side in (wrapper, form))
    out: list = []

    def put(x, free: bool):
        out.append(["?", [_bare(x)]] if free else x)

    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        left, right = wrapper[i:j], form[k:m]
        if kind == "equal":
            for x, y in zip(left, right):
                put(x, _optional(x) or _optional(y))
        elif len(left) == 1 and left[0][0] == "+" and left[0][1] == right:
            out.append(left[0])
        elif len(right) == 1 and right[0][0] == "+" and right[0][1] == left:
            out.append(right[0])
        elif len(left) == len(right) and all(map(_texts, left, right)):  # unequal texts at one place
            for x, y in zip(left, right):
                put(SLOT, _optional(x) or _optional(y))
        else:
            for x in left + right:
                put(x, True)
    return out


def infer(forms: list[list]) -> list:
    """Wrapper of a host from its distinct folded forms, in the order given."""
    wrapper: list = []
    for k, form in enumerate(forms):
        wrapper = merge(wrapper, form) if k else form
    return wrapper


def places_of(tokens: list[str]) -> list[tuple[bool, bool, int]]:
    """For each slot of a token stream, whether it is in no part set apart, whether in an article, and the place of the table or list around it (-1: none)."""
    stack: list[str] = []
    lists: list[tuple[int, int]] = []  # depth and place of the open tables and lists
    places = []
    for k, t in enumerate(tokens):
        while lists and lists[-1][0] >= len(stack):
            lists.pop()
        if t.startswith(SLOT):
            apart = any(x.endswith("!") or x in ASIDE for x in stack)
            places.append((not apart, any(x.rstrip("!") in MAIN for x in stack), lists[-1][1] if lists else -1))
        elif t.startswith("/"):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d].rstrip("!") == t[1:]:
                    del stack[d:]
                    break
        elif t.rstrip("!") not in NO_END:
            if t.rstrip("!") in LOOSE:
                while stack and stack[-1].rstrip("!") in LOOSE and (stack[-1].rstrip("!") == t.rstrip("!") or stack[-1].rstrip("!") == "p"):
                    stack.pop()
            if t.rstrip("!") == "body" and stack and stack[-1] == "head":
                stack.pop()
            if t.rstrip("!") in LISTS:
                lists.append((len(stack), k))
            stack.append(t)
    return places


def content_slots(tokens: list[str], fixed: list[bool] | None = None) -> list[bool]:
    """For each slot of a token stream, whether it is main text: in no part set apart, and in the article if there is one, else not ``fixed``.

    A table or list that holds a text of the page's own is data, whose repeated cells and headings are not template.
    """
    places = places_of(tokens)
    fixed = fixed or [False] * len(places)
    inside = any(ok and main for ok, main, _ in places)
    data = {group for (ok, _, group), f in zip(places, fixed) if ok and not f and group >= 0}
    return [ok and (main if inside else not f or group in data) for (ok, main, group), f in zip(places, fixed)]


def flat(wrapper: list) -> list[str]:
    """All tokens of a wrapper, each group once."""
    out = []
    for x in wrapper:
        out += flat(x[1]) if isinstance(x, list) else [x]
    return out


class Matcher:
    """A wrapper as an automaton that parses the pages of its host.

    A state is a token, a pair of states to go on with, or the end (None). All ways through the expression are followed
    at once, each state at most by the way that is preferred, so a page costs its length times the wrapper's and nothing
    depends on the clock.
    """

    def __init__(self, wrapper: list, common: frozenset = frozenset()):
        self.common = common
        self.states: list = []
        #: Whether the text at a state is template: a constant in no repeated group that also has slots.
        self.template: list[bool] = []
        self._kept: dict = {}
        self._add(wrapper, False)
        self._state(None)

    def _state(self, x, template: bool = False) -> int:
        self.states.append(x)
        self.template.append(template)
        return len(self.states) - 1

    def _add(self, items: list, data: bool) -> None:
        for x in items:
            if isinstance(x, str):
                self._state(x, x.startswith(SLOT) and x != SLOT and not data)
            elif x[0] == "?":
                fork = self._state(None)
                self._add(x[1], data)
                self.states[fork] = (fork + 1, len(self.states))
            else:
                first = len(self.states)
                self._add(x[1], data or SLOT in flat(x[1]))
                self._state((first, len(self.states) + 1))

    def _reach(self, state: int, way, seen: set, out: list) -> None:
        """Adds the token states to be reached without reading, in order of preference: another copy or the optional item first."""
        stack = [state]
        while stack:
            state = stack.pop()
            if state in seen:
                continue
            seen.add(state)
            if isinstance(self.states[state], tuple):
                stack += reversed(self.states[state])
            else:
                out.append((state, way))

    def parse(self, tokens: list[str]) -> list[int] | None:
        """The state that each text of a page fills, or None if the expression does not fit. A text is read as its constant rather than as a slot."""
        ways: list = []
        self._reach(0, None, set(), ways)
        for t in tokens:
            text = t.startswith(SLOT)
            went = [(s, w) for s, w in ways if self.states[s] == t]
            if text and t != SLOT:
                went += [(s, w) for s, w in ways if self.states[s] == SLOT]
            seen, ways = set(), []
            for s, way in went:
                self._reach(s + 1, (way, s) if text else way, seen, ways)
            if not ways:
                return None
        last = len(self.states) - 1
        way = next((w for s, w in ways if s == last), False)
        if way is False:
            return None
        filled = []
        while way:
            way, s = way
            filled.append(s)
        return filled[::-1]

    def slots_of(self, tokens: list[str]) -> list[bool] | None:
        """Whether each text of a page is content; None if the wrapper does not fit the page.

        A page may leave out any optional group, so whether it has an article, and what lies in it, is read off
        its own tags; which of its texts are template follows from the places of the wrapper that they fill.
        """
        key = tuple(tokens)
        if key not in self._kept:
            filled = self.parse(tokens)
            chosen = None if filled is None else content_slots(tokens, [self.template[s] for s in filled])
            if len(self._kept) >= KEEP:
                self._kept.clear()
            self._kept[key] = chosen
        return self._kept[key]


def extract(page: str, matcher: Matcher | None) -> str:
    """Blocks of the main text, joined by blank lines. A page that its wrapper does not fit is judged by its own tags."""
    tokens, texts = stream(page)
    chosen = matcher.slots_of(marked(tokens, texts, matcher.common)) if matcher else None
    if chosen is None:
        chosen = content_slots(tokens)
    return "\n\n".join(t for t, ok in zip(texts, chosen) if ok)


def common_texts(pages: DataFrame) -> DataFrame:
    """host, common: digests of the texts outside marked parts that many of the host's different pages without an article share.

    Pages with the same texts count once; hosts without common texts are left out.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, texts = stream(page)
                places = places_of(tokens)
                if any(ok for ok, _, _ in places) and not any(ok and main for ok, main, _ in places):
                    seen[host, digest("\0".join(texts))] = sorted({digest(t) for t, (ok, _, _) in zip(texts, places) if ok})
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in seen], pa.string()), pa.array([p for _, p in seen], pa.int64()),
                pa.array(list(seen.values()), pa.list_(pa.int64()))], names=["host", "page", "texts"])

    each = pages.mapInArrow(digests, "host string, page long, texts array<long>").groupBy("host", "page").agg(F.first("texts").alias("texts"))
    each = store(each, workspace(pages.sparkSession, "page-texts"))
    often = each.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_PAGES)
    totals = each.groupBy("host").agg(F.count("*").alias("pages"))
    return often.join(totals, "host").where(F.col("n") >= COMMON_SHARE * F.col("pages")).groupBy("host").agg(
        F.sort_array(F.collect_list("text")).alias("common"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, common: the wrapper of each host, from all its pages, and the common texts (or null) that its constants are chosen from."""
    common = store(common_texts(pages), workspace(pages.sparkSession, "common"))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for host, page, known in zip(*(batch.column(k).to_pylist() for k in range(3))):
                form = json.dumps(fold(marked(*stream(page), frozenset(known or ()))))
                seen[host, form] = seen.get((host, form), 0) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in seen], pa.string()), pa.array([f for _, f in seen], pa.string()),
                pa.array(list(seen.values()), pa.int64())], names=["host", "form", "n"])

    counted = pages.join(common, "host", "left").select("host", "html", "common").mapInArrow(
        forms, "host string, form string, n long").groupBy("host", "form").agg(F.sum("n").alias("n"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "wrapper"], ascending=[False, True])
        made = json.dumps(infer([json.loads(f) for f in group["wrapper"]]))
        return pd.DataFrame([[group["host"].iloc[0], made, group["n"].sum()]], columns=["host", "wrapper", "n"])

    # Distinct forms meet, however many pages a host has; those of a host with many forms in salted parts, then part with part.
    level = store(counted.withColumnRenamed("form", "wrapper"), workspace(pages.sparkSession, "forms"))
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("parts"))
        if (sizes.agg(F.max("parts")).first()[0] or 0) <= 1:
            return level.select("host", "wrapper").join(common, "host", "left")
        salted = level.join(sizes, "host").withColumn("salt", F.expr(f"pmod(xxhash64(wrapper), ceil(parts / {FAN}))"))
        level = store(salted.groupBy("host", "salt").applyInPandas(one, "host string, wrapper string, n long"), workspace(pages.sparkSession, "partial"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages give an empty text; repeated rows each give one. Pages without a
    readable host share a wrapper. Pages of any length are read whole; other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"))
    found = store(wrappers(rows.select("host", "html")), workspace(pages.sparkSession, "wrappers"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = []
            for page, wrapper, common in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                key = wrapper, tuple(common or ())
                if key not in known:
                    known[key] = Matcher(json.loads(wrapper), frozenset(key[1]))
                texts.append(extract(page, known[key]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.join(found, "host").select("page_id", "url", "html", "wrapper", "common").mapInArrow(
        read, "page_id long, url string, text string, n_chars long")
