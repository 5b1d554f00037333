"""Template residue, filler and error-page text in place of content (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paleoline.llm.text import clean_base
from paleoline.session import materialise, small_or_plain

# The forms of unfilled slots.
_NAME = r"[A-Za-z_][\w.\-]*"
SLOTS = [
    rf"\{{\{{\s*[#/^&]?{_NAME}(?:\s*\|[^{{}}]*)?\s*\}}\}}",
    rf"\{{%-?\s*{_NAME}[^%{{}}]*%\}}",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"\{{\${_NAME}\}}",
    r"<%[=\-]?\s*[\w.$@\s]+%>",
    r"<xsl:[a-z-]+\b[^<>]*>",
    r"<\?(?:php|=)[^<>]*\?>",
    rf"%%{_NAME}%%",
    rf"@@{_NAME}@@",
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",
    r"<<\s*[A-Z][A-Z_ ]*\s*>>",
    rf"%\({_NAME}\)[sd]",
    r"\[[^\[\]\n]{1,40}\bgoes here\]",
    r"\[(?:INSERT|YOUR|ADD|ENTER|REPLACE|PLACEHOLDER)\b[^\[\]\n]{0,40}\]",
    r"\[(?:insert|your|add|enter)\s[^\[\]\n]{1,40}\]",
    r"\[(?:aquí va|insertar|inserte|hier steht|hier einfügen|insérer|inserire|inserir)\b[^\[\]\n]{0,60}\]",
]
_SLOT = re.compile("|".join(SLOTS))
_SLOT_ANY_CASE = re.compile(SLOTS[-1] + "|" + SLOTS[12], re.I)
_MAY_SLOT = re.compile(r"[{\[<%@]|__")

# Words of the usual filler text, and phrases that ask for a text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split())
LOREM_SURE = frozenset("lorem amet consectetur adipiscing adipisicing elit eiusmod tempor incididunt nostrud ullamco aliquip".split())
FILLER_PHRASES = [
    r"\blorem ipsum\b", r"\bdummy text\b", r"\bfiller text\b", r"\bplaceholder text\b", r"\bsample (?:paragraph|text)\b",
    r"\breplace this text\b", r"\binsert (?:the )?text\b", r"\byour (?:text|title|description|content) (?:goes )?here\b",
    r"\b(?:text|description|title|content) goes here\b", r"\b(?-i:TBD|TODO|FIXME)\s*:", r"\btexto de (?:relleno|prueba|ejemplo)\b",
    r"\baquí (?:irá|va) (?:el|la)\b", r"\bblindtext\b", r"\bplatzhalter(?:text)?\b", r"\btexte (?:de remplissage|factice)\b", r"\btesto segnaposto\b", r"\btexto de preenchimento\b",
    r"\b(?:content|text) (?:is )?coming soon\b", r"\b(?:inhalt|text) folgt\b", r"\bpr[óo]ximamente\b", r"\btexto provisional\b", r"\b(prueba|prova|probe|essai|test)(?:\W+\d+)?\W+\1(?:\W+\d+)?\W+\1\b",
]
_FILLER = re.compile("|".join(FILLER_PHRASES), re.I)
#: Whatever a filler phrase has one of.
_FILLER_KEYS = ("lorem", " goes here", "text here", "title here", "description here", "content here", "dummy", "filler", "placeholder", "sample", "replace this", "insert", "tbd", "todo", "fixme", "relleno", "prueba", "ejemplo", "aquí", "blindtext", "platzhalter", "remplissage", "factice", "segnaposto", "preenchimento", "coming soon", "folgt", "ximamente", "provisional", "prova prova", "probe probe", "essai essai", "test test")
#: Keyboard words that are filler as soon as they stand twice in a row.
KEYBOARD = frozenset("abc abcd abcde asdf asdfg qwert qwerty qwertz test foo bla blah xyz zxcv hjkl lorem".split())
_LONGEST_REPEAT = 6
_SIGNS, _KEYS = 1 << 40, 1 << 41


def _word_id(w: str, n: int) -> int:
    """``n``, but one number for all runs of the same sign, and marked ones for keyboard words."""
    if len(w) > 1 and len(set(w)) == 1 and not w.isdigit():
        return _SIGNS + ord(w[0])
    core = w.strip(".,;:!?-").lower()
    return _KEYS + hash(core) % _SIGNS if core in KEYBOARD else n


def repeated_words(texts: list[str]) -> list[bool]:
    """Whether a text has filler by repetition.

    One word eight times in a row, runs of one sign (xxx xx xxxx) four times, a keyboard word twice, or two to six words
    eight times, or four times if they make up half of the text: a refrain within a text is none.
    """
    ids: dict[str, int] = {}
    words = [_TAG.sub(" ", t).split() if "<" in t else t.split() for t in texts]
    for w in words:
        for v in w:
            if v not in ids:
                ids[v] = _word_id(v, len(ids))
    size = np.array([len(w) for w in words])
    flat = np.fromiter((x for w in words for x in (*map(ids.__getitem__, w), -1)), np.int64, int(size.sum()) + len(words))
    owner = np.repeat(np.arange(len(words)), size + 1)
    out = np.zeros(len(words), bool)
    for p in range(1, _LONGEST_REPEAT + 1):
        if len(flat) <= p:
            break
        same = np.concatenate([[False], (flat[p:] == flat[:-p]) & (flat[p:] >= 0), [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        start, length = edge[::2], edge[1::2] - edge[::2]
        if p == 1:
            need = np.where(flat[start] >= _KEYS, 1, np.where(flat[start] >= _SIGNS, 3, 7))
        else:
            need = np.where(2 * (length + p) >= size[owner[start]], 3 * p, 7 * p)
        out[owner[start[length >= need]]] = True
    return out.tolist()


# Notices in place of content. Each must cover the better part of its sentence or line.
NOTICES = [
    r"(?:http )?(?:error )?\b[45]\d\d\b[ –:-]*(?:page )?(?:not found|forbidden|bad gateway|service unavailable|internal server error|gateway time-?out|unauthorized|bad request|gone|moved)?",
    r"(?:the )?(?:requested |page |resource |file |document |work )+[^.;\n]{0,60}(?:not found|not be (?:found|located)|moved or deleted|does not exist|no longer exists|unavailable)[^.;\n]{0,40}",
    r"page (?:not found|unavailable)", r"not found", r"(?:this|the) (?:content|page|work|text|document|volume|resource|item|file) (?:isn't|is not|is no longer|is currently not|cannot be|could not be) (?:available|accessible|found|displayed|shown)[^.;\n]{0,40}", r"this (?:content|page|work|text|document|volume|resource|item|file) (?:does not|doesn't|no longer) exists?[^.;\n]{0,30}", r"(?:403 )?forbidden", r"bad gateway", r"(?:internal )?server error", r"service (?:temporarily )?unavailable",
    r"we could not find (?:that|this|the) \w+", r"nothing to see at this address", r"check the address or search again", r"go back to the \w+", r"return to the \w+",
    r"(?:access|permission) denied", r"you (?:do not|don't) have (?:permission|access)[^.;\n]{0,40}", r"your access has been (?:limited|blocked|denied)[^.;\n]{0,40}", r"too many requests",
    r"session (?:has )?expired", r"please (?:log|sign) in[^.;\n]{0,60}", r"please (?:try again|wait|reload|refresh|come back)[^.;\n]{0,40}", r"try again (?:later|in)[^.;\n]{0,30}", r"wait \d+ \w+",
    r"(?:please )?(?:enable|turn on|activate|allow) (?:java ?script|scripts?|cookies)[^.;\n]{0,60}", r"turn (?:java ?script|scripts?) on[^.;\n]{0,60}", r"(?:this \w+|you) (?:needs?|requires?|need to have) (?:java ?script|scripts?|scripting)[^.;\n]{0,50}", r"java ?script is (?:required|disabled)[^.;\n]{0,40}",
    r"unable to load [^.;\n]{1,60}", r"(?:the )?connection (?:timed out|refused|reset)[^.;\n]{0,30}", r"(?:an? )?(?:unexpected )?error (?:has )?occurred[^.;\n]{0,60}", r"under (?:construction|maintenance)", r"(?:request|incident|reference) (?:id|code|no\.?)\s*[\w-]+",
    r"traceback \(most recent call last\)", r"file \"[^\"]+\", line \d+(?:, in \w+)?", r"\w*(?:error|exception)\s*:\s*'[^']*'", r"exerr\s*:\s*error[^\n]{0,120}", r"in function\s*:?[^\n]{0,60}", r"render\s*:\s*page\(node\(\)\)", r"(?:fatal |warning|parse )?error(?: on line)? \d*",
    r"p[áa]gina no encontrada[^.;\n]{0,40}", r"la (?:obra|p[áa]gina) que busca no existe[^.;\n]{0,60}", r"acceso denegado", r"no tiene permiso[^.;\n]{0,60}", r"lo sentimos,? se ha producido un error[^.;\n]{0,40}", r"vuelva a intentarlo[^.;\n]{0,30}", r"servicio no disponible[^.;\n]{0,30}", r"c[óo]digo de incidencia[^.;\n]{0,20}", r"es necesario activar java ?script[^.;\n]{0,60}", r"su navegador tiene desactivados los scripts[^.;\n]{0,60}", r"act[íi]velos para [^.;\n]{0,40}", r"(?:la )?sesi[óo]n (?:ha )?caducad[ao][^.;\n]{0,30}", r"demasiadas (?:peticiones|solicitudes)[^.;\n]{0,30}",
    r"fehler(?: \d+)?", r"die angeforderte (?:seite|datei|ressource)[^.;\n]{0,60}", r"seite nicht (?:gefunden|verf[üu]gbar)[^.;\n]{0,20}", r"zugriff verweigert[^.;\n]{0,30}", r"bitte aktivieren sie (?:java ?script|cookies)[^.;\n]{0,60}", r"(?:ihre )?sitzung (?:ist )?abgelaufen[^.;\n]{0,30}", r"zu viele anfragen[^.;\n]{0,20}", r"dienst nicht verf[üu]gbar[^.;\n]{0,30}",
    r"erreur(?: \d+)?", r"page (?:introuvable|non trouv[ée]e)[^.;\n]{0,30}", r"le document demand[ée] n'existe plus[^.;\n]{0,40}", r"acc[èe]s (?:refus[ée]|interdit)[^.;\n]{0,40}", r"veuillez activer java ?script[^.;\n]{0,60}", r"session expir[ée]e[^.;\n]{0,30}", r"service indisponible[^.;\n]{0,30}",
    r"errore(?: \d+)?", r"pagina non trovata[^.;\n]{0,30}", r"accesso negato[^.;\n]{0,30}", r"p[áa]gina n[ãa]o encontrada[^.;\n]{0,30}", r"acesso negado[^.;\n]{0,30}",
]
_NOTICE = re.compile("(?:" + "|".join(NOTICES) + r")(?!\w)[^\w\n<]*", re.I)
#: Whatever a notice has one of, as it is quickest to look for; and its number.
_NOTICE_KEYS = ("error", "exception", "exerr", "fehler", "erreur", "script", "page", "found", "nothing", "address", "forbidden", "gateway", "server", "service", "dienst", "access ", "available", " exist", "angefordert", "accès", "acceso", "acesso", "permission", "permiso", "request", "session", "sesión", "sesion", "sitzung", "please", "unable to load", "connection", "construction", "maintenance", "traceback", "página", "pagina", "vuelva", "servicio", "demasiad", "seite", "zugriff", "bitte", "veuillez", "actív", "active ", "try again", "wait ", "enable ", "turn on", "in function", 'file "', "render:", "render :")
_NOTICE_NUMBER = re.compile(r"[45]\d\d(?!\d)")

# Words of notices, as one weak sign among the evidence.
WEAK = frozenset("error page seite página pagina adresse address server browser navegador navigateur javascript script scripts request anfrage access acceso accès zugriff denied unavailable expired login log reload enable aktivieren activar activer erreur fehler http nginx apache cloudflare captcha cookies timeout timed permission permiso resource existe encontrada encontrado trouvé gefunden found missing sorry maintenance".split())

# Furniture that stands on a page beside its text.
FURNITURE = [
    r"home", r"works", r"authors", r"dictionary", r"search", r"about", r"help", r"contact", r"inicio", r"obras", r"autores", r"contacto", r"start(?:seite)?", r"accueil", r"imprint", r"privacy(?: policy)?", r"impressum", r"datenschutz", r"nginx(?:/[\d.]+)?", r"apache(?:/[\d.]+)?",
    r"cookie settings", r"report a problem", r"back to the (?:\w+ of )?\w+", r"volver al? \w+", r"zur[üu]ck zur? \w+", r"retour (?:à|a|au) (?:la |l')?\w+", r"digital edition of the printed works", r"skip to content", r"terms of use", r"©.{0,60}", r"copyright.{0,60}", r"menu", r"print", r"next", r"previous",
]
_FURNITURE = re.compile(r"(?:(?:" + "|".join(FURNITURE) + r")(?!\w)[ \t|·•>/,.]*)+", re.I)
_TAG = re.compile(r"</?(?:h[1-6]|p|div|span|b|i|em|strong|br|hr|a|title|head|body|html|center|pre|code|ul|ol|li)\b[^<>]*>", re.I)
# What else a page has beside its words.
_PAGE = re.compile(r"<!--.*?-->|<!doctype\b[^<>]*>|<(script|style)\b[^<>]*>.*?</\1\s*>|" + _TAG.pattern + r"|</?(?:nav|header|footer|main|section|article|aside|noscript|table|thead|tbody|tfoot|tr|td|th|form|input|button|label|img|svg|path|meta|link|small|sup|sub|u|font|blockquote|dl|dt|dd|figure|iframe)\b[^<>]*>", re.I | re.S)
_STOP = re.compile(r"\n+|(?<=[.!?:;])\s+|\s{3,}")
_TITLE_LINE = re.compile(r"\s*[A-ZÀ-Þ][^.!?;:\n]{2,80}\n\s*(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")


def notice_parts(t: str, title: str | None) -> tuple[int, int]:
    """(letters of notices, of other words) of a text of any length without tags, furniture and title.

    Phrases are read from the start of a line or sentence, or where the last phrase ended, so a text that quotes or
    discusses a message has other words around it. A first line without a full stop may be a title. Reading ends early
    only where the rest can't make the text a notice.
    """
    body = _PAGE.sub("\n", t).strip() if "<" in t else t.strip()
    notice = other = at = 0
    if (m := _TITLE_LINE.match(body)) and not _NOTICE.match(body) and not _FURNITURE.match(body):
        at = m.end()
    if title and title.strip() and body[at : at + 2 * len(title)].lower().startswith(title.strip().lower()):
        at += len(title.strip())
    while at < len(body):
        if 3 * other > notice + len(body) - at:
            break
        if body[at].isspace() or body[at] in "|·•-–—*.":
            at += 1
        elif m := _NOTICE.match(body, at):
            notice += max(1, sum(map(len, _WORD.findall(m.group()))))
            at = m.end()
        elif m := _FURNITURE.match(body, at):
            at = m.end()
        else:
            stop = _STOP.search(body, at)
            end = stop.end() if stop else len(body)
            other += sum(map(len, _WORD.findall(body[at:end])))
            at = end
    return notice, other


def has_slot(t: str) -> bool:
    return bool(_MAY_SLOT.search(t)) and bool(_SLOT.search(t) or _SLOT_ANY_CASE.search(t))


def has_filler(t: str) -> bool:
    low = t.lower()
    if any(k in low for k in _FILLER_KEYS) and _FILLER.search(t):
        return True
    if "consectetur" in low or "amet" in low or "adipisci" in low:
        run = sure = 0
        for w in _WORD.findall(low):
            if w in LOREM:
                run, sure = run + 1, sure + (w in LOREM_SURE)
                if run >= 6 and sure >= 3:
                    return True
            else:
                run = sure = 0
    return False


_SCHEMA = "doc string, key bigint, slot boolean, filler boolean, notice boolean"


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The detectors: each reads one text for itself."""
    for b in batches:
        rows = []
        texts = [t if t.isascii() and not _CONTROL.search(t) else clean_base(t, "\n")[0] for t in b["text"]]
        for i, key, text, title, again in zip(b["doc"], b["key"], texts, b["title"], repeated_words(texts)):
            notice = other = 0
            low = text.lower()
            if any(k in low for k in _NOTICE_KEYS) or _NOTICE_NUMBER.search(text):
                notice, other = notice_parts(text, title)
            rows.append((i, key, has_slot(text), again or has_filler(text), notice > 0 and notice >= 3 * other))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        yield out[out["slot"] | out["filler"] | out["notice"]]


#: Share of a text's distinct letters that repeated segments must cover, share of a segment's texts that are so covered, and letters of a text for each copy it needs.
COVERED, PURE, LETTERS_A_COPY = 0.75, 0.5, 10


def segments(rows: DataFrame) -> DataFrame:
    """``rows`` with ``host``, ``title`` and ``segs`` of each text: distinct segments (hash ``h``, letters ``n``) without tags and title.

    Segments end at stops, line ends and bars. Case, blanks and invisible characters don't count, and the part of a token
    from a digit or a sign of code on stands for any other, so answers that differ in a number, a path or a name are one
    template. All of it runs inside the engine, in four passes over a text.
    """
    title, t = _parts_of(F.col("text"), F.col("title"))
    out = rows.select("row", "doc_id", "key", "host", title.alias("title"), t.alias("t"))
    parts = F.split(F.regexp_replace("t", r"[0-9$/\\_'\"=@#]\S*", "0"), r"[.!?;:\n|·•]")
    plain = F.transform(parts, lambda x: F.regexp_replace(x, r"[^\p{L}0]+", ""))
    sized = F.transform(F.array_distinct(plain), lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(F.replace(x, F.lit("0"), F.lit(""))).alias("n")))
    return out.select("row", "doc_id", "key", "host", F.xxhash64("title").alias("title"), F.filter(sized, lambda s: s["n"] > 0).alias("segs"))


def _parts_of(text: Column, title: Column) -> tuple[Column, Column]:
    """Title and text in lower case, the text without tags and the title before it."""
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b[^<>]*>.*?</\1\s*>|</?[a-z!][^<>]*>", "\n")).otherwise(text)
    bare = F.trim(F.lower(bare), F.lit(" \n\r"))
    title = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return title, F.when((title != "") & F.startswith(bare, title), F.substr(bare, F.char_length(title) + 1)).otherwise(bare)


def _with_terms(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``own``: whether the text has a longer word of its title, ``weak``: whether words of notices are at least two and one in a hundred."""
    title, t = _parts_of(F.col("text"), F.col("title"))
    theirs = F.filter(F.split(title, r"[^\p{L}]+"), lambda w: F.char_length(w) > 4)
    out = rows.select("doc_id", "key", theirs.alias("theirs"), F.regexp_extract_all(F.regexp_replace(t, r"\p{Cf}+", ""), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    weak = F.filter("w", lambda x: x.isin(*sorted(WEAK)))
    signs = (F.size(F.array_distinct(weak)) >= 2) & (100 * F.size(weak) >= F.size("w"))
    return out.select("doc_id", "key", F.arrays_overlap("theirs", "w").alias("own"), signs.alias("weak")).distinct()


def repeated_answers(docs: DataFrame, texts: DataFrame, least_copies: int = 3, least_hosts: int = 2) -> DataFrame:
    """Rows whose text is a repeated answer of little information in place of a content: ``row``, ``copies``, ``hosts``.

    ``docs`` comes from :func:`segments`, ``texts`` are the same rows with ``key``. A segment is repeated if at least ``least_copies`` texts have it,
    under ``least_hosts`` hosts and under different titles (or none): no title tells what it says. A text is covered if
    repeated segments are ``COVERED`` of its distinct letters. Formulas, headings and navigation are repeated too, but most
    of their texts have other words beside them; a segment is an answer only if at least ``PURE`` of its texts are covered.
    A covered text with an answer and without a word of its title is the result, if the answer has a copy for every
    ``LETTERS_A_COPY`` letters of the text, so a long text that merely stands in several places is none; ``least_copies``
    are enough where words of notices support it. No list of phrases takes part, so any language counts.

    A segment is counted where it stands before it is shuffled, and only hashes and counts are; rows of repeated
    segments are found by a broadcast only if their number is proven small. ``least_hosts`` is 1 or 2.
    """
    if least_hosts not in (1, 2):
        raise ValueError("least_hosts is 1 or 2")
    each = docs.select("row", "host", "title", F.explode("segs").alias("s")).select("row", "host", "title", "s.h", "s.n")
    stat = each.groupBy("h").agg(F.count("*").alias("copies"), F.min("host").alias("h0"), F.max("host").alias("h1"), F.min("title").alias("t0"), F.max("title").alias("t1"))
    none = F.xxhash64(F.lit(""))
    differ = (F.col("t0") != F.col("t1")) | (F.col("t0") == none)
    hosts = F.when(F.col("h0") != F.col("h1"), 2).otherwise(1)
    often = materialise(stat.where((F.col("copies") >= least_copies) & (hosts >= least_hosts) & differ).select("h", "copies", hosts.alias("hosts")), "residue-repeated")
    size = F.aggregate("segs", F.lit(0), lambda a, s: a + s["n"])
    held = each.join(small_or_plain(often.select("h")), "h").groupBy("row").agg(F.sum("n").alias("held"))
    total = docs.select("row", "doc_id", "key", size.alias("letters"), "segs")
    covered = materialise(total.join(held, "row").where(F.col("held") >= COVERED * F.col("letters")), "residue-covered")
    own = covered.select("row", F.explode("segs.h").alias("h"))
    pure = own.groupBy("h").agg(F.count("*").alias("k")).join(often, "h").where(F.col("k") >= PURE * F.col("copies")).select("h", "copies", "hosts")
    best = own.join(small_or_plain(materialise(pure, "residue-pure")), "h").groupBy("row").agg(F.max("copies").alias("copies"), F.max("hosts").alias("hosts"))
    best = materialise(covered.select("row", "doc_id", "key", "letters").join(best, "row"), "residue-best")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    few = small_or_plain(best.select("doc_id", "key").distinct())
    terms = materialise(_with_terms(texts.join(few, same(texts, few), "left_semi")), "residue-terms")
    enough = F.when(F.col("weak"), F.lit(float(least_copies))).otherwise(F.greatest(F.lit(float(least_copies)), F.col("letters") / LETTERS_A_COPY))
    out = best.join(terms, same(best, terms), "left").where(~F.coalesce("own", F.lit(False)) & (F.col("copies") >= enough))
    return out.select("row", F.col("copies").cast("bigint").alias("copies"), F.col("hosts").cast("bigint").alias("hosts"))


def residue(docs: DataFrame, host: str = "source", least_copies: int = 3, least_hosts: int = 2) -> DataFrame:
    """What each document holds in place of content: ``doc_id``, ``reason``, ``copies``, ``hosts``; ``reason`` null means none.

    ``slot``: an unfilled template slot anywhere; ``filler``: filler text anywhere (phrases that ask for a text, runs of
    filler words, the same words again and again); ``mismatch``: title, body, copies and hosts show a repeated answer of
    little information (:func:`repeated_answers`, with the number of its copies, and 2 hosts for two or more); ``notice``:
    the answer is too rare for that, but apart from tags, title and page furniture the text is an error, access or script
    notice by its phrases. All of it holds for whole texts of any length, which are read without invisible characters and
    in usual widths and blanks.

    Defined cases: null or empty text has no reason; null title or host is allowed (a null host is no second one);
    repeated rows are judged each for itself; an empty table gives no rows. ``docs`` needs ``doc_id``, ``text``, ``title``
    and the host column.
    """
    rows = docs.select("doc_id", "text", "title", F.col(host).alias("host"))
    some = rows.where("text <> ''").withColumn("key", F.xxhash64("text", "title", "host"))
    held = materialise(segments(some.withColumn("row", F.monotonically_increasing_id())), "residue-segments")
    seen = materialise(some.select(F.col("doc_id").cast("string").alias("doc"), "key", "text", "title").mapInPandas(_detect, _SCHEMA).distinct(), "residue-detected")
    again = materialise(repeated_answers(held, some, least_copies, least_hosts), "residue-answers")
    d = small_or_plain(seen.withColumnRenamed("key", "_key"))
    out = held.select("row", "doc_id", "key").join(d, F.col("doc_id").cast("string").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("_key")), "left").join(small_or_plain(again), "row", "left")
    reason = F.when(F.col("slot"), "slot").when(F.col("filler"), "filler").when(F.col("copies").isNotNull(), "mismatch").when(F.col("notice"), "notice")
    out = out.select("doc_id", reason.alias("reason"), "copies", "hosts")
    empty = rows.where("text is null or text = ''").select("doc_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("bigint").alias("hosts"))
    return out.unionByName(empty)


def keep_content(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents without a reason in ``marks``."""
    return docs.join(marks.where("reason is not null").select("doc_id").distinct(), "doc_id", "left_anti")
