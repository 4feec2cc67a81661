"""Marked-up books (S08, K07): a lossless token stream, verses read from it, and verses written back into it.

A book is markers, each with its attributes, and text. The kinds of markers that hold no verse text are few and listed
here; the text of any other marker is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Notes and figures, from their marker to its end marker.
NOTES = frozenset("f fe ef efe x ex fig".split())
#: Numbers beside the text, from their marker to its end marker.
NUMBERS = frozenset("ca cp va vp pro rq".split())
#: Paragraphs that are no verse text (identification, introductions, titles, headings, remarks), without their levels.
HEADINGS = frozenset(
    "id ide usfm sts rem h toc toca mt mte imt imte is ip ipi im imi ipq imq ipr iq ib ili iot io iex ie cl cp cd ms mr s sr r d sp sd lit restore".split()
)
#: Paragraphs (and table rows and peripherals) of text, without their levels.
PARAGRAPHS = frozenset("p m po pr cls pmo pm pmc pmr pi mi nb pc pb ph phi b q qr qc qa qm qd lh li lf lim tr nb c periph".split())
TOKEN = re.compile(r"\\(\*|\+?[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\*?)([ \t]?)")


@dataclass
class Token:
    """marker: with its `*`, empty for text; raw: all characters it stands for, so that the raws make up the book."""

    marker: str
    raw: str


def tokens(content: str) -> Iterator[Token]:
    at = 0
    for m in TOKEN.finditer(content):
        if m.start() > at:
            yield Token("", content[at : m.start()])
        blank = "" if m[1].endswith("*") else m[2]  # an end marker's blank is text
        at = m.start() + 1 + len(m[1]) + len(blank)
        yield Token(m[1], content[m.start() : at])
    if at < len(content):
        yield Token("", content[at:])


def level_free(marker: str) -> str:
    return re.sub(r"\d+(-\d+)?$", "", marker.removeprefix("+"))


@dataclass
class Piece:
    """A stretch of a book: token, the verses it belongs to, whether it is of a note or heading, and what it says of the verses."""

    token: Token
    chapter: int
    verses: tuple[int, ...]
    apart: bool
    text: str


def pieces(content: str) -> Iterator[Piece]:
    """All tokens of a book, in order, with the verse text that each holds.

    Text belongs to the verses of the last \\v of its chapter, unless it stands in a heading's paragraph, a note, a figure, a
    number beside the text or the attributes behind a `|`. Paragraphs, lines and table cells are parted by a blank.
    """
    chapter, verses, inside, heading, attributes = 0, (), [], False, False
    wanted = ""  # a marker whose number comes next
    for t in tokens(content):
        name, text = t.marker.rstrip("*"), ""
        plain = level_free(name)
        if t.marker:
            wanted, attributes = "", False
            if t.marker.endswith("*"):
                if inside and level_free(inside[-1]) == plain:
                    inside.pop()
            elif plain in NOTES or plain in NUMBERS and name != "cp":
                inside.append(name)
            elif inside and plain not in PARAGRAPHS | HEADINGS | {"v"}:
                pass  # a style within a note
            elif plain in ("c", "v") and name == plain:
                wanted, inside, heading = plain, [], heading and plain == "v"
                if plain == "c":
                    verses, heading = (), False
                elif plain == "v":
                    heading = False
            elif plain in HEADINGS:
                heading, inside = True, []
            elif plain in PARAGRAPHS or plain in ("tc", "th", "tcr", "thr", "tcc", "thc"):
                heading, inside, text = False, [], " "
        elif wanted:
            m = re.match(r"\s*(\d+)[^\s\d-]*(?:-(\d+)[^\s\d-]*)?", t.raw) if wanted == "v" else re.match(r"\s*(\d+)", t.raw)
            if m and wanted == "c":
                chapter = int(m[1])
            elif m:
                verses = tuple(range(int(m[1]), max(int(m[2] or m[1]), int(m[1])) + 1))
                text = " " + t.raw[m.end() :]
            wanted = ""
        else:
            text = t.raw
        if not t.marker and text and not inside and not heading:
            attributes = attributes or "|" in text
            text = text.split("|")[0] if "|" in text else text
        kept = "" if inside or heading else text.replace("//", " ").replace("~", "\u00a0")
        yield Piece(t, chapter, verses if chapter else (), bool(inside) or heading, kept)


def verse_rows(content: str) -> list[tuple[str, int, int, str]]:
    """(book, chapter, verse, text); of a range of verses the first has the text, the others <range>. A verse that comes
    again goes on. A book begins at its \\id."""
    rows: dict[tuple[str, int, int], str] = {}
    book, before = "", ""
    for p in pieces(content):
        if before == "id" and not p.token.marker:
            book = (p.token.raw.split() or [""])[0][:3].upper()
        before = p.token.marker
        for v in p.verses:
            first, key = v == p.verses[0], (book, p.chapter, v)
            rows.setdefault(key, "" if first else "<range>")
            if first and p.text:
                rows[key] = rows[key].removeprefix("<range>") + p.text
    return [(*key, re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")) for key, text in rows.items()]


def updated(content: str, verses: dict[tuple[int, int], str], keep_styles: bool = True) -> str:
    """The book with the text of some verses (chapter, verse) replaced; all else comes back as it was, character by character.

    The new text stands at the verse's first text. Paragraphs, lines, notes and headings of the verse stay where they are,
    behind it; its other words go, and without keep_styles the markers of their character styles too. Verses of a
    range are replaced by the text of its first verse.
    """
    out, done, open_styles = [], set(), []
    for p in pieces(content):
        key = (p.chapter, p.verses[0]) if p.verses else None
        if key not in verses:
            out.append(p.token.raw)
            continue
        marker = p.token.marker
        if not marker and p.text.strip():
            raw = p.token.raw
            lead = raw[: len(raw) - len(raw.lstrip())]
            number = re.match(r"\s*\d+[^\s\d-]*(?:-\d+[^\s\d-]*)?[ \t]?", raw) if out and re.fullmatch(r"\\v[ \t]?", out[-1]) else None
            tail = re.search(r"\s*\Z", raw)[0]
            if key in done:
                out.append(tail if "\n" in tail else "")
                continue
            done.add(key)
            out.append((number[0] if number else lead) + verses[key] + (tail or ""))
        elif not marker and re.fullmatch(r"\\v[ \t]?", out[-1] if out else "") and key not in done:
            number = re.match(r"\s*\d+[^\s\d-]*(?:-\d+[^\s\d-]*)?", p.token.raw)
            rest = p.token.raw[number.end() :] if number else p.token.raw
            done.add(key)
            out.append((number[0] if number else "") + " " + verses[key] + (rest.lstrip(" \t") or rest))
        elif not keep_styles and not p.apart and is_style(marker):
            continue
        else:
            out.append(p.token.raw)
    return "".join(out)


def is_style(marker: str) -> bool:
    """Whether a marker begins or ends a character style."""
    plain = level_free(marker.rstrip("*"))
    return bool(marker) and plain not in NOTES | NUMBERS | HEADINGS | PARAGRAPHS | {"v", "c", ""}
