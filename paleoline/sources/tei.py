"""Edition XML to lines and back: a shredder over whole documents, and a writer for expansions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paleoline.functions.align import changed_words
from paleoline.functions.text import ABBR_CLOSE, ABBR_OPEN
from paleoline.schema import LINE_COLUMNS, LINE_SCHEMA
from paleoline.session import materialise
from paleoline.sources.characters import characters

_XML = "{http://www.w3.org/XML/1998/namespace}"
# Elements that own lines.
_STRUCTURE = frozenset("l list p head lg epigraph note titlePage div".split())
#: Branches of a choice and the views that read them.
_BRANCH = {"abbr": (0, 1), "expan": (2, 3), "sic": (0, 2), "corr": (1, 3), "orig": (0, 1, 2, 3), "reg": ()}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "#"


def admitted(root: ET.Element) -> bool:
    """Whether a document is ready: revision approved, no project note that excludes it, and not a volume's wrapper."""
    status = {e.get("status") for e in root.iter() if _name(e) == "revisionDesc"}
    notes = [p.get(_XML + "id", "") for d in root.iter() if _name(d) == "editorialDecl" for p in d if _name(p) == "p"]
    kinds = {e.get("type") for e in root if _name(e) == "text"}
    return bool(status & {"g_enriched_approved", "h_revised"}) and not any("AEW" in x or "RW" in x for x in notes) and "work_volume" not in kinds


@dataclass
class _Line:
    id: str
    owner: ET.Element | None
    cell: ET.Element | None
    row: ET.Element | None
    in_note: bool
    page: str
    brk: str
    text: list[list[str]] = field(default_factory=lambda: [[], [], [], []])
    langs: dict[str, None] = field(default_factory=dict)
    abbr: bool = False
    sic: bool = False
    link: str = ""


def _tidy(parts: list[str]) -> str:
    t = re.sub(r"[ \t\r\n]+", " ", "".join(parts)).strip(" ")
    return re.sub(f" *{ABBR_CLOSE}", ABBR_CLOSE, re.sub(f"{ABBR_OPEN} *", ABBR_OPEN, t)) if ABBR_OPEN in t or ABBR_CLOSE in t else t


class _Shredder:
    """One walk in document order. Each stream (main text, each note) has four views, and each view a line it writes to.

    In a choice only some views read a branch; a line break moves only those, and its twin (``sameAs``) in the other branch
    moves the rest, so a choice that straddles a break falls apart at the right place in every view.
    """

    def __init__(self, root: ET.Element, file_name: str, note_initial: bool) -> None:
        self.root, self.file, self.note_initial = root, file_name, note_initial
        self.glyphs = characters()
        self.lines: list[_Line] = []
        self.by_id: dict[str, _Line] = {}
        self.stack: list[ET.Element] = []
        self.at: list[_Line | None] = [None] * 4
        self.last: _Line | None = None
        self.page = ""
        self.pages = {e.get(_XML + "id"): e.get("facs", "") for e in root.iter() if _name(e) == "pb"}

    def run(self) -> list[_Line]:
        for e in self.root:
            if _name(e) == "text":
                self.visit(e, (0, 1, 2, 3))
        return self.lines

    def nearest(self, *names: str) -> ET.Element | None:
        return next((e for e in reversed(self.stack) if _name(e) in names), None)

    def lang(self) -> str:
        return next((v for e in reversed([self.root, *self.stack]) if (v := e.get(_XML + "lang"))), "")

    def write(self, text: str | None, views: tuple[int, ...], mark: bool = False) -> None:
        if not text:
            return
        cell, row = self.nearest("cell"), self.nearest("row")
        for v in views:
            line = self.at[v]
            if line is None or line.owner is not None and not any(e is line.owner for e in self.stack):
                continue
            if line.cell is not None and cell is not None and cell is not line.cell and row is line.row:
                continue
            line.text[v].append(text)
            if not mark:
                if x := self.lang():
                    line.langs.setdefault(x)
                line.abbr |= self.nearest("abbr") is not None
                line.sic |= self.nearest("sic") is not None

    def break_line(self, e: ET.Element, views: tuple[int, ...]) -> None:
        same = e.get("sameAs")
        if same is not None:
            line = self.by_id.get(same.lstrip("#"))
            for v in views if line is not None else ():
                self.at[v] = line
            return
        owner = self.nearest(*_STRUCTURE)
        line = _Line(e.get(_XML + "id", f"__lb_{len(self.lines)}"), owner, self.nearest("cell"), self.nearest("row"), self.nearest("note") is not None, self.page, e.get("break", ""))
        self.stack.append(e)
        if x := self.lang():
            line.langs.setdefault(x)
        self.stack.pop()
        line.abbr, line.sic = self.nearest("abbr") is not None, self.nearest("sic") is not None
        if self.last is not None and line.brk == "no":
            self.last.link = line.id
        self.last = line
        self.lines.append(line)
        self.by_id.setdefault(line.id, line)
        for v in views:
            self.at[v] = line

    def choice(self, e: ET.Element, views: tuple[int, ...]) -> None:
        before = self.last
        # The branch with the break itself comes before the one with its twin.
        kids = sorted(e, key=lambda k: not any(_name(x) == "lb" and x.get("sameAs") is None for x in k.iter()))
        self.stack.append(e)
        for k in kids:
            n = _name(k)
            read = tuple(v for v in views if v in _BRANCH.get(n, (0, 1, 2, 3)))
            if n == "abbr":
                self.write(ABBR_OPEN, tuple(v for v in read if v < 2), True)
            self.visit(k, read)
            if n == "abbr":
                self.write(ABBR_CLOSE, tuple(v for v in read if v < 2), True)
        self.stack.pop()
        if self.last is not before:
            for v in views:
                self.at[v] = self.last

    def visit(self, e: ET.Element, views: tuple[int, ...]) -> None:
        """The element's own content; its tail belongs to the parent."""
        n = _name(e)
        if n in ("#", "cb"):
            return
        if n == "pb":
            same = e.get("sameAs")
            self.page = self.pages.get(same.lstrip("#"), "") if same else e.get("facs", "")
            return
        if n == "lb":
            self.break_line(e, views)
            return
        if n == "g":
            pre, comp, std = self.glyphs.get(e.get("ref", "").lstrip("#"), (None, None, None))
            self.stack.append(e)
            self.write(pre or comp or "".join(e.itertext()) or std or "@", views)
            self.stack.pop()
            return
        if n == "choice":
            self.choice(e, views)
            return
        outer = (self.at, self.last)
        if n == "note":
            self.at, self.last = [None] * 4, None
            if self.note_initial:
                self.note_start(e)
        self.stack.append(e)
        self.write(e.text, views)
        for k in e:
            self.visit(k, views)
            self.write(k.tail, views)
        self.stack.pop()
        if n == "note":
            self.at, self.last = outer

    def note_start(self, e: ET.Element) -> None:
        """A line of its own for a note's text before its first break, placed before the note's first line."""
        line = _Line(f"{e.get(_XML + 'id', f'__note_{len(self.lines)}')}__init", e, None, None, True, self.page, "")
        self.at, self.last = [line] * 4, line
        self.lines.append(line)


def shred(xml: str, file_name: str = "", check: bool = True, note_initial: bool = False) -> list[dict]:
    """Lines of one document as rows of the line table; none if the document isn't admitted."""
    root = ET.fromstring(xml)
    if check and not admitted(root):
        return []
    out = []
    for line in _Shredder(root, file_name, note_initial).run():
        views = [_tidy(t) for t in line.text]
        if line.id.endswith("__init") and not any(views):
            continue
        facs = re.sub("^facs:", "", line.page)
        out.append(dict(zip(LINE_COLUMNS, (
            line.id, root.get(_XML + "id", ""), file_name, line.owner.get(_XML + "id", "") if line.owner is not None else "", _name(line.owner) if line.owner is not None else "", facs, "", "",
            list(line.langs), str(line.in_note).lower(), str(line.abbr).lower(), str(line.sic).lower(), *views, line.link,
        ))))
    return out


def read_tei(spark: SparkSession, path: str, note_initial: bool = False) -> DataFrame:
    """Lines of all documents under a path, one file a document; file name and image addresses included."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("xml"))
    return shred_documents(files, note_initial)


def shred_documents(docs: DataFrame, note_initial: bool = False, check: bool = True) -> DataFrame:
    """Lines of documents given as ``file_name`` and ``xml``. A document that isn't well-formed fails the query, as it would lose lines unseen."""
    from paleoline.functions.text import facs_url

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f, x in zip(b["file_name"], b["xml"]) if x for r in shred(x, f or "", check, note_initial)]
            yield pd.DataFrame(rows, columns=LINE_COLUMNS)

    lines = docs.select("file_name", "xml").mapInPandas(run, LINE_SCHEMA)
    url = facs_url("facs_id")
    return lines.withColumns({"image_info_url": url, "image_jpg_url": F.when(url != "", F.concat(url, F.lit("/full/full/0/default.jpg"))).otherwise("")})


# --- expansions back into the document ---


@dataclass
class _Run:
    holder: ET.Element
    tail: bool
    start: int
    end: int


def _runs(root: ET.Element) -> tuple[dict[str, list[_Run]], dict[str, ET.Element], dict[ET.Element, ET.Element]]:
    """Where each line's plain text stands in the tree: element and whether its text or tail; notes are lines of their own, of a choice only the original branch counts and isn't touched."""
    parent = {k: e for e in root.iter() for k in e}
    runs: dict[str, list[_Run]] = {}
    breaks: dict[str, ET.Element] = {}
    state: dict[str, str | None] = {"at": None}

    def add(e: ET.Element, tail: bool, text: str | None) -> None:
        if text and state["at"] is not None:
            r = runs.setdefault(state["at"], [])
            n = r[-1].end if r else 0
            r.append(_Run(e, tail, n, n + len(text)))

    def walk(e: ET.Element) -> None:
        n = _name(e)
        if n == "lb":
            if e.get("sameAs") is None:
                state["at"] = e.get(_XML + "id", f"__lb_{len(breaks)}")
                breaks[state["at"]] = e
            return
        if n in ("pb", "cb", "fw", "#"):
            return
        if n == "choice":
            src = next((k for k in e if _name(k) == "abbr"), None)
            src = src if src is not None else next((k for k in e if _name(k) == "sic"), None)
            if src is not None:
                add(e, False, "".join(src.itertext()))
            return
        outer = state["at"]
        if n == "note":
            state["at"] = None
        add(e, False, e.text)
        for k in e:
            walk(k)
            add(k, True, k.tail)
        if n == "note":
            state["at"] = outer

    body = next((e for e in root.iter() if _name(e) == "body"), root)
    add(body, False, body.text)
    for k in body:
        walk(k)
        add(k, True, k.tail)
    return runs, breaks, parent


def _text(r: _Run) -> str:
    if _name(r.holder) == "choice" and not r.tail:
        src = next((k for k in r.holder if _name(k) in ("abbr", "sic")), None)
        return "".join(src.itertext()) if src is not None else ""
    return (r.holder.tail if r.tail else r.holder.text) or ""


def _set(r: _Run, text: str) -> None:
    if r.tail:
        r.holder.tail = text
    else:
        r.holder.text = text


def _wrap(runs: list[_Run], parent: dict[ET.Element, ET.Element], s: int, e: int, expansion: str) -> bool:
    """Put the stretch into a choice with its expansion; the choice stands where the stretch begins, and what lies inside it (notes, page breaks) follows it."""
    hit = [r for r in runs if r.start < e and r.end > s]
    if not hit or any(_name(r.holder) == "choice" and not r.tail for r in hit):
        return False
    ns = hit[0].holder.tag.partition("}")[0] + "}" if "}" in str(hit[0].holder.tag) else ""
    choice = ET.Element(ns + "choice")
    abbr, expan = ET.SubElement(choice, ns + "abbr"), ET.SubElement(choice, ns + "expan")
    abbr.text, expan.text = "".join(_text(r)[max(0, s - r.start) : e - r.start] for r in hit), expansion
    first = hit[0]
    whole = _text(first)
    choice.tail = whole[e - first.start :] if first.end > e else ""
    _set(first, whole[: s - first.start])
    for r in hit[1:]:
        _set(r, _text(r)[e - r.start :] if r.end > e else "")
    home = parent[first.holder] if first.tail else first.holder
    home.insert(list(home).index(first.holder) + 1 if first.tail else 0, choice)
    parent[choice] = home
    return True


def apply_expansions(xml: str, expanded: dict[str, str], nonbreaking: set[str] = frozenset(), wrap_inserts: bool = False) -> tuple[str, int]:
    """The document with changed words of each line wrapped in a choice, and ``break="no"`` on the breaks before continued words; and how many changes were left out, as they meet a choice that is already there."""
    root = ET.fromstring(xml)
    for e in root.iter():
        if isinstance(e.tag, str) and e.tag.startswith("{"):
            ET.register_namespace("", e.tag[1:].partition("}")[0])
            break
    runs, breaks, parent = _runs(root)
    skipped = 0
    for line, text in expanded.items():
        own = runs.get(line, [])
        plain = "".join(map(_text, own))
        for s, e, s2, e2 in reversed(changed_words(plain, text, wrap_inserts)):
            skipped += not _wrap(own, parent, s, e, text[s2:e2])
    for line in nonbreaking:
        if line in breaks:
            breaks[line].set("break", "no")
    return ET.tostring(root, encoding="unicode"), skipped


def plain_lines(xml: str) -> list[tuple[str, str]]:
    """(id, text) of every line as the round trip sees it."""
    runs, breaks, _ = _runs(ET.fromstring(xml))
    return [(k, "".join(map(_text, runs.get(k, [])))) for k in breaks]


def extract_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents (``file_name``, ``xml``) as the round trip sees them: ``file_name``, ``id``, ``doc_id``, ``file_pos`` (place in the document), ``source_sic``, ``lang``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, x in zip(b["file_name"], b["xml"]):
                if x:
                    root = ET.fromstring(x)
                    lang = root.get(_XML + "lang")
                    out += [(f, i, root.get(_XML + "id", "doc"), k, t, [lang] if lang else []) for k, (i, t) in enumerate(plain_lines(x))]
            yield pd.DataFrame(out, columns=["file_name", "id", "doc_id", "file_pos", "source_sic", "lang"])

    return docs.select("file_name", "xml").mapInPandas(run, "file_name string, id string, doc_id string, file_pos bigint, source_sic string, lang array<string>")


def process_documents(docs: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From XML to XML in one call: ``file_name``, ``xml``, ``skipped``.

    ``pipeline`` gets the documents' lines (:func:`extract_lines`) and gives ``id``, ``expanded_text`` and
    ``predicted_next_line``, such as :func:`paleoline.operators.infer.run_pipeline`; line ids must be unique over all
    documents. Lines that it leaves out stay as they are, and a document without lines comes back unchanged.
    """
    docs = materialise(docs.select("file_name", "xml"), "xml-in")
    lines = materialise(extract_lines(docs), "xml-lines")
    done = pipeline(lines).select("id", F.col("expanded_text").alias("text"), F.coalesce("predicted_next_line", F.lit("")).alias("next_id"))
    return write_expansions(docs, lines.select("file_name", "id").join(done, "id"))


def write_expansions(docs: DataFrame, expanded: DataFrame) -> DataFrame:
    """``file_name``, ``xml``, ``skipped`` (changes left out): documents (``file_name``, ``xml``) with ``expanded`` (``file_name``, ``id``, ``text``, ``next_id``: the line whose break continues a word, or empty).

    A document and its lines meet in one task, bounded by the document itself, which is one file. A null text changes nothing.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        new = {i: t for i, t in zip(right["id"], right["text"]) if t is not None}
        out = [(f, *apply_expansions(x, new, {n for n in right["next_id"] if n})) if x and len(right) else (f, x, 0) for f, x in zip(left["file_name"], left["xml"])]
        return pd.DataFrame(out, columns=["file_name", "xml", "skipped"])

    return docs.groupBy("file_name").cogroup(expanded.groupBy("file_name")).applyInPandas(run, "file_name string, xml string, skipped int")
