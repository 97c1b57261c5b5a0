"""HTML extraction by two-pass block rules.

Tags that make blocks cut a page into blocks of text. The first pass classes each block by
its length, its share of stop words and the share of its characters in links: good, bad, or
the ambiguous "short" and "near". In the second pass ambiguous short blocks inherit the
label of their nearest decided neighbours; near-good ones are bad only between bad ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_WORDS = frozenset(
    # English, German, French, Spanish function words
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which with you "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so um und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous à "
    "al como con del el ella ellos era es ese esta este fue ha la las lo los más me mi muy no nos o para pero por que se ser si sin su sus te un una y ya".split()
)
LOW, HIGH, SHORT, LONG, LINKS = 0.10, 0.20, 70, 200, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)
# The same where no ">" is left, so that no "<" is tried as a tag all the way to the end.
_TAIL = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\Z)|((?!))?((?!))?([^<]+|<)", re.S | re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("noscript", "template", "svg")}  # skipped only up to an end tag
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul br".split())
_WORD = re.compile(r"\w+")
_TITLE = re.compile(r"h[1-6]")


def blocks(html: str | None) -> list[tuple[str, int, bool]]:
    """(text, characters in links, heading or not) of each block with text, in order."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked, links, heading, breaks = 0, 0, False, 0

    def end() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, min(links, len(text)), heading))
        parts.clear()
        links = 0

    page, at, open_ = html or "", 0, set()
    last = page.rfind(">")
    while at < len(page):
        m = (_TOKEN if at < last else _TAIL).match(page, at)
        tag, text, at = m[3], m[4], m.end()
        if text is not None:
            if linked:
                links += len(" ".join(unescape(text).split()))
            if breaks == 1:
                parts.append(" ")
            breaks = 0 if text.strip() else breaks
            parts.append(text)
        elif tag is not None:
            tag = tag.lower()
            if tag in _CLOSED:
                if not m[2] and tag not in open_ and not (tag == "svg" and m[0].endswith("/>")):
                    close = _CLOSED[tag].search(page, at)
                    if close:
                        at = close.end()
                    else:  # nor has a later one an end tag
                        open_.add(tag)
                if tag != "svg":
                    parts.append(" ")
            elif tag == "a":
                linked = max(0, linked - 1) if m[2] else linked + 1
            elif tag == "br":
                breaks += 1
                if breaks == 2:  # one break is a space, two part blocks
                    end()
            elif tag in _BLOCK:
                end()
                linked = 0
                if _TITLE.fullmatch(tag):
                    heading = not m[2]
            else:
                continue
        elif m[1] is not None:
            if m[1].lower() == "title":
                end()
            else:
                parts.append(" ")
    end()
    return out


def first_pass(text: str, links: int) -> str:
    """good, bad, short or near, from the block alone."""
    n = len(text)
    if links / n > LINKS or "\xa9" in text:
        return "bad"
    if n < SHORT:
        return "bad" if links else "short"
    words = _WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if share >= HIGH:
        return "good" if n > LONG else "near"
    return "near" if share >= LOW else "bad"


def second_pass(labels: list[str]) -> list[str]:
    """good or bad for each block; the page's ends count as bad."""
    n = len(labels)
    left, right = ["bad"] * n, ["bad"] * n  # nearest good or bad neighbour, and whether a near one lies between
    left_near, right_near = [False] * n, [False] * n
    for order, side, near in ((range(n), left, left_near), (range(n - 1, -1, -1), right, right_near)):
        now, seen = "bad", False
        for i in order:
            side[i], near[i] = now, seen
            if labels[i] in ("good", "bad"):
                now, seen = labels[i], False
            elif labels[i] == "near":
                seen = True
    out = []
    for i, x in enumerate(labels):
        if x == "short":
            if left[i] == right[i]:
                x = left[i]
            else:  # between a good and a bad one: a near-good block on the bad side decides for good
                x = "good" if (left_near[i] if left[i] == "bad" else right_near[i]) else "bad"
        elif x == "near":
            x = "bad" if left[i] == right[i] == "bad" else "good"
        out.append(x)
    return out


def extract_page(html: str | None) -> tuple[str, int, int]:
    """(main text, blocks, good blocks). A short heading counts as near-good if good text follows it."""
    found = blocks(html)
    first = [first_pass(t, k) for t, k, _ in found]
    for i, (_, _, heading) in enumerate(found):
        if heading and first[i] == "short" and i + 1 < len(found) and "good" in first[i + 1 : i + 2]:
            first[i] = "near"
    kept = [t for (t, _, _), x in zip(found, second_pass(first)) if x == "good"]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_good) of every page.

    * null, empty or text-less html: empty text and no blocks; unclosed tags, comments,
      scripts, styles, titles and text areas run to the end of the page; an unclosed head,
      svg, noscript or template does not; a null id is carried
    * very long pages are read whole, in time that grows with their length
    * ties: a short block between a good and a bad one goes by the near-good rule above
    * repeated rows each give a row; an empty table gives an empty result
    * other columns are ignored, whatever their names
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract_page(x.as_py()) for x in b.column("html")]
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["page_id", "text", "n_blocks", "n_good"])

    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("html"))
    return one.mapInArrow(run, "page_id long, text string, n_blocks int, n_good int")
